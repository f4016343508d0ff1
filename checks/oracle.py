"""SQL counterparts of the registered queries, written from the definitions and run by an independent engine.

They use the engine's own quantiles, ranks and joins, so they share no method with the Spark side.
"""

from __future__ import annotations

# ---- fixed values, written out here so that a wrong constant of the package shows ------------------------------
GRADES_V1 = ((800, "A - Excellent"), (650, "B - Bon"), (500, "C - Moyen"), (350, "D - Risqué"), (None, "E - Très risqué"))
GRADES_V2 = ((800, "A - Excellent"), (700, "B - Bon"), (587, "C - Moyen"), (400, "D - Risqué"), (None, "E - Très risqué"))
DECISIONS_V1 = ((650, "ACCEPTÉ"), (500, "À EXAMINER"), (None, "REFUSÉ"))
DECISIONS_V2 = ((724, "ACCEPTÉ"), (587, "À EXAMINER"), (None, "REFUSÉ"))
RECOMMENDATIONS = {
    "ACCEPTÉ": "Client éligible. Taux de défaut observé sur ce segment : 2,7%. "
               "Procéder à l'octroi selon les conditions standards.",
    "À EXAMINER": "Dossier à examiner par le comité. Taux de défaut observé : 9,7%. "
                  "Vérifier les garanties et l'historique relationnel.",
    "REFUSÉ": "Profil à risque élevé. Taux de défaut observé : 58,8%. "
              "Refus recommandé ou demande de garanties exceptionnelles.",
}

# ---- loans over the given tables ---------------------------------------------------------------------------
_LOANS = """
joined AS (
  SELECT l.*, o.o_orderpriority, c.c_custkey, c.c_acctbal, c.c_mktsegment, n.n_name, p.p_type,
         (l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709 + l_linenumber::BIGINT*15485863) % 10007 AS h
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey
  JOIN nation n ON c_nationkey = n_nationkey JOIN part p ON l_partkey = p_partkey
),
columns_ AS (
  SELECT 'CLI' || lpad((l_orderkey*8 + l_linenumber)::VARCHAR, 9, '0') AS client_id,
    (15 + (c_custkey*7919) % 70)::INTEGER AS age,
    n_name AS ville, c_mktsegment AS secteur_activite, o_orderpriority AS type_emploi,
    CASE WHEN h % 131 <> 7 THEN 1 + (h*31) % 239 END::INTEGER AS anciennete_client_mois,
    CASE WHEN h % 211 <> 3 THEN floor((c_acctbal+1200)*120) END::BIGINT AS revenu_mensuel_fcfa,
    p_type AS type_produit,
    floor(l_extendedprice*(1 + (l_partkey*13) % 60)*(CASE WHEN h % 20 = 0 THEN 4 ELSE 1 END))::BIGINT
      AS montant_credit_fcfa,
    CASE l_quantity::BIGINT % 8 WHEN 0 THEN 6 WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 36 WHEN 4 THEN 60
      WHEN 5 THEN 84 WHEN 6 THEN 120 ELSE 180 END::INTEGER AS duree_mois,
    (700 + (l_discount*8000)::BIGINT)::DOUBLE / 100.0::DOUBLE AS taux_interet,
    CASE WHEN h % 137 <> 5 THEN l_returnflag || l_linestatus END AS garantie,
    CASE WHEN (h*37) % 100 < 12 THEN 1 WHEN (h*37) % 100 < 14 THEN 2 ELSE 0 END::INTEGER AS nb_incidents_24m,
    (l_linenumber % 4)::INTEGER AS nb_credits_en_cours,
    l_shipdate AS date_octroi, h
  FROM joined
),
ratios AS (
  SELECT *, CASE WHEN revenu_mensuel_fcfa IS NOT NULL THEN least(greatest(
      montant_credit_fcfa::DOUBLE / duree_mois::DOUBLE / revenu_mensuel_fcfa::DOUBLE, 0.0::DOUBLE), 3.0::DOUBLE) END
      AS ratio_endettement
  FROM columns_
),
base AS (
  SELECT *,
    CASE type_produit WHEN 'ECONOMY' THEN 0.25 WHEN 'LARGE' THEN 0.10 WHEN 'MEDIUM' THEN 0.30 WHEN 'PROMO' THEN 0.20
      WHEN 'SMALL' THEN 0.15 WHEN 'STANDARD' THEN 0.35 END::DOUBLE * 0.35::DOUBLE
    + CASE secteur_activite WHEN 'AUTOMOBILE' THEN 0.20 WHEN 'BUILDING' THEN 0.28 WHEN 'FURNITURE' THEN 0.15
      WHEN 'HOUSEHOLD' THEN 0.30 ELSE 0.05 END::DOUBLE * 0.20::DOUBLE
    + coalesce(ratio_endettement, 0.0::DOUBLE) * 0.20::DOUBLE
    + nb_incidents_24m::DOUBLE * 0.15::DOUBLE
    + CASE WHEN anciennete_client_mois < 12 THEN 1.0 ELSE 0.0 END::DOUBLE * 0.10::DOUBLE
    + ((h*53) % 2001 - 1000)::DOUBLE * 0.00008::DOUBLE AS score_risque
  FROM ratios
),
labelled AS (
  SELECT *, (score_risque > (SELECT quantile_cont(score_risque, 0.78) FROM base))::INTEGER AS defaut FROM base
),
arrears AS (
  SELECT *, CASE WHEN defaut = 1 THEN 30 + (h*17) % 470 ELSE 0 END::INTEGER AS jours_retard FROM labelled
),
classed AS (
  SELECT *, CASE WHEN jours_retard < 1 THEN 'Saine' WHEN jours_retard < 90 THEN 'Observation'
    WHEN jours_retard < 180 THEN 'Douteuse' WHEN jours_retard < 360 THEN 'Litigieuse' ELSE 'Irrecouvrable' END
    AS classification_cobac FROM arrears
),
once AS (
  SELECT *, round_even(montant_credit_fcfa::DOUBLE * CASE classification_cobac WHEN 'Saine' THEN 0.0
    WHEN 'Observation' THEN 0.05 WHEN 'Douteuse' THEN 0.30 WHEN 'Litigieuse' THEN 0.50 ELSE 1.0 END::DOUBLE, 0)::BIGINT
    AS provision_fcfa FROM classed
),
raw AS (
  SELECT client_id, age, ville, secteur_activite, type_emploi, anciennete_client_mois, revenu_mensuel_fcfa,
    type_produit, montant_credit_fcfa, duree_mois, taux_interet, garantie, nb_incidents_24m, nb_credits_en_cours,
    date_octroi, ratio_endettement, defaut, jours_retard, classification_cobac, provision_fcfa
  FROM (SELECT * FROM once UNION ALL SELECT * FROM once WHERE h % 97 = 0)
)
"""

_FIFTEEN = (
    "age, ville, secteur_activite, type_emploi, anciennete_client_mois, revenu_mensuel_fcfa, type_produit, "
    "montant_credit_fcfa, duree_mois, taux_interet, garantie, nb_incidents_24m, nb_credits_en_cours, "
    "ratio_endettement, defaut"
)

_CLEAN = f"""
s2 AS (SELECT * FROM raw WHERE age >= 18 AND age <= 80),
s3 AS (SELECT * FROM s2 WHERE revenu_mensuel_fcfa >= 50000
       AND revenu_mensuel_fcfa <= (SELECT quantile_cont(revenu_mensuel_fcfa, 0.99) FROM s2)),
s4 AS (SELECT * FROM s3 WHERE montant_credit_fcfa >= 100000
       AND montant_credit_fcfa <= (SELECT quantile_cont(montant_credit_fcfa, 0.995) FROM s3)),
s5 AS (SELECT * FROM s4 WHERE ratio_endettement >= 0 AND ratio_endettement <= 1.5),
s6 AS (SELECT {_FIFTEEN}, min(date_octroi) AS date_octroi FROM s5 GROUP BY ALL),
feat AS (
  SELECT * REPLACE (round_even(montant_credit_fcfa::DOUBLE / duree_mois::DOUBLE / revenu_mensuel_fcfa::DOUBLE, 3)
      AS ratio_endettement),
    CASE WHEN age > 17 AND age <= 30 THEN '18-29' WHEN age > 30 AND age <= 45 THEN '30-44'
      WHEN age > 45 AND age <= 60 THEN '45-59' WHEN age > 60 AND age <= 100 THEN '60+' END AS tranche_age,
    CASE WHEN revenu_mensuel_fcfa > 0 AND revenu_mensuel_fcfa <= 200000 THEN '<200k'
      WHEN revenu_mensuel_fcfa > 200000 AND revenu_mensuel_fcfa <= 500000 THEN '200-500k'
      WHEN revenu_mensuel_fcfa > 500000 AND revenu_mensuel_fcfa <= 1000000 THEN '500k-1M'
      WHEN revenu_mensuel_fcfa > 1000000 THEN '>1M' END AS tranche_revenu,
    CASE WHEN montant_credit_fcfa > 0 AND montant_credit_fcfa <= 500000 THEN '<500k'
      WHEN montant_credit_fcfa > 500000 AND montant_credit_fcfa <= 2000000 THEN '500k-2M'
      WHEN montant_credit_fcfa > 2000000 AND montant_credit_fcfa <= 10000000 THEN '2M-10M'
      WHEN montant_credit_fcfa > 10000000 THEN '>10M' END AS tranche_montant,
    round_even(montant_credit_fcfa::DOUBLE / duree_mois::DOUBLE / revenu_mensuel_fcfa::DOUBLE * 100, 2) AS taux_effort,
    CASE type_produit WHEN 'ECONOMY' THEN 0.25 WHEN 'LARGE' THEN 0.10 WHEN 'MEDIUM' THEN 0.30 WHEN 'PROMO' THEN 0.20
      WHEN 'SMALL' THEN 0.15 WHEN 'STANDARD' THEN 0.35 END::DOUBLE AS risque_produit,
    round_even(ln(1 + revenu_mensuel_fcfa::DOUBLE), 3) AS revenu_log,
    round_even(ln(1 + montant_credit_fcfa::DOUBLE), 3) AS montant_log
  FROM s6
),
dated AS (
  SELECT * REPLACE (coalesce(anciennete_client_mois,
      (SELECT quantile_cont(anciennete_client_mois, 0.5) FROM feat))::INTEGER AS anciennete_client_mois)
  FROM feat
),
credits AS (SELECT * EXCLUDE (date_octroi) FROM dated)
"""

_SURROGATE = """
scored AS (
  SELECT *, defaut AS label, score_p AS proba, (score_p > 0.35::DOUBLE)::INTEGER AS prediction,
    round_even((1.0::DOUBLE - score_p) * 1000, 0)::INTEGER AS score,
    floor((1.0::DOUBLE - score_p) * 1000)::INTEGER AS score_floor
  FROM (SELECT *, risque_produit * 0.35::DOUBLE
    + CASE secteur_activite WHEN 'AUTOMOBILE' THEN 0.20 WHEN 'BUILDING' THEN 0.28 WHEN 'FURNITURE' THEN 0.15
      WHEN 'HOUSEHOLD' THEN 0.30 ELSE 0.05 END::DOUBLE * 0.20::DOUBLE
    + least(ratio_endettement, 1.5::DOUBLE) * 0.20::DOUBLE
    + nb_incidents_24m::DOUBLE * 0.15::DOUBLE
    + CASE WHEN anciennete_client_mois < 12 THEN 1.0 ELSE 0.0 END::DOUBLE * 0.10::DOUBLE AS score_p
  FROM credits)
)
"""


def _raw(sql: str, *more: str) -> str:
    return f"WITH {', '.join([_LOANS, *more])} {sql}"


def _credits(sql: str, *more: str) -> str:
    return f"WITH {', '.join([_LOANS, _CLEAN, *more])} {sql}"


def _scored(sql: str, *more: str) -> str:
    return _credits(sql, _SURROGATE, *more)


_SIZES = """per_class AS (SELECT defaut, count(*) AS c, sum(count(*)) OVER () AS n FROM credits GROUP BY 1),
  exact AS (SELECT defaut, c * ceil(n * 0.25::DOUBLE) / n AS e, ceil(n * 0.25::DOUBLE) AS total FROM per_class),
  sizes AS (SELECT defaut, floor(e) + (row_number() OVER (ORDER BY e - floor(e) DESC, defaut)
    <= total - sum(floor(e)) OVER ())::INTEGER AS k FROM exact)"""

# ---- recurring pieces --------------------------------------------------------------------------------------
N = "count(*)"
BAD = "sum(defaut)::BIGINT"
RATE = "round(100.0::DOUBLE * sum(defaut)::DOUBLE / count(*), 2)"
MEAN = "sum(defaut)::DOUBLE / count(defaut)"
RATE_EVEN = f"round_even({MEAN} * 100, 2)"
EXPOSURE = "sum(montant_credit_fcfa)::BIGINT"
LOST = "sum(CASE WHEN defaut = 1 THEN montant_credit_fcfa ELSE 0 END)::BIGINT"
CLASS_SQL = """CASE WHEN taux_effort < 30 AND nb_incidents_24m = 0 THEN '1. Saine'
  WHEN taux_effort < 40 AND nb_incidents_24m = 0 THEN '2. Observation'
  WHEN taux_effort < 50 OR nb_incidents_24m = 1 THEN '3. Douteuse' ELSE '4. Litigieuse' END"""
CLASS_MASKS = """CASE WHEN taux_effort >= 50 AND nb_incidents_24m = 1 THEN 'Litigieuse'
  WHEN taux_effort >= 40 OR nb_incidents_24m = 1 THEN 'Douteuse'
  WHEN taux_effort >= 30 AND nb_incidents_24m = 0 THEN 'Observation' ELSE 'Saine' END"""
_HASHED = (
    "age", "ville", "secteur_activite", "type_emploi", "anciennete_client_mois", "revenu_mensuel_fcfa",
    "type_produit", "montant_credit_fcfa", "duree_mois", "garantie", "nb_incidents_24m", "nb_credits_en_cours",
    "defaut", "round_even(taux_interet * 100, 0)::BIGINT",
)
LOAN_HASH = "('0x' || substr(md5(concat_ws('|', '42', " + ", ".join(
    f"coalesce(({c})::VARCHAR, '\\N')" for c in _HASHED) + ")), 1, 15))::BIGINT"


def _text(expr: str) -> str:
    return f"({expr})::VARCHAR"


def _cut(value: str, cutoffs) -> str:
    arms = [f"WHEN {value} >= {c} THEN '{label}'" for c, label in cutoffs if c is not None]
    return f"CASE {' '.join(arms)} ELSE '{cutoffs[-1][1]}' END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _segment(key: str) -> str:
    return (f"SELECT {key}, count(defaut) AS nb_prets, round({MEAN}, 9) AS mean, {RATE_EVEN} AS taux_defaut "
            f"FROM credits WHERE {key} IS NOT NULL GROUP BY 1")


def _sheet(key: str, rate: str = "taux_defaut_pct") -> str:
    return (f"SELECT {key}, count(defaut) AS nb_prets, {BAD} AS nb_defauts, {RATE_EVEN} AS {rate} "
            f"FROM credits WHERE {key} IS NOT NULL GROUP BY 1")


def _survivors(step: str) -> str:
    return _credits(f"""SELECT count(*) AS nb, {BAD} AS nb_defauts, min(age) AS age_min, max(age) AS age_max,
      max(revenu_mensuel_fcfa) AS revenu_max, max(montant_credit_fcfa) AS montant_max,
      max(ratio_endettement) AS ratio_max FROM {step}""")


def _band(band: str, value: str) -> str:
    return _credits(f"""SELECT {band}, count(*) AS nb, min({value}) AS valeur_min, max({value}) AS valeur_max
      FROM credits GROUP BY 1""")


def _by_score(name: str, cutoffs) -> str:
    return _scored(f"""SELECT {_cut('score_floor', cutoffs)} AS {name}, count(*) AS nb, min(score_floor) AS score_min,
      max(score_floor) AS score_max FROM scored GROUP BY 1""")


_RAW_COLUMNS = {
    "client_id": "VARCHAR", "age": "INT", "ville": "VARCHAR", "secteur_activite": "VARCHAR",
    "type_emploi": "VARCHAR", "anciennete_client_mois": "INT", "revenu_mensuel_fcfa": "BIGINT",
    "type_produit": "VARCHAR", "montant_credit_fcfa": "BIGINT", "duree_mois": "INT", "taux_interet": "DOUBLE",
    "garantie": "VARCHAR", "nb_incidents_24m": "INT", "nb_credits_en_cours": "INT", "date_octroi": "TIMESTAMP",
    "ratio_endettement": "DOUBLE", "defaut": "INT", "jours_retard": "INT", "classification_cobac": "VARCHAR",
    "provision_fcfa": "BIGINT",
}
_SPARK_TYPE = {"VARCHAR": "string", "INT": "int", "BIGINT": "bigint", "DOUBLE": "double", "TIMESTAMP": "timestamp"}
_NUMERIC = [c for c, t in _RAW_COLUMNS.items() if t in ("INT", "BIGINT", "DOUBLE")]
_TEXT = [c for c, t in _RAW_COLUMNS.items() if t == "VARCHAR"]


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _dtypes() -> str:
    kinds: dict[str, list[str]] = {}
    for c, t in _RAW_COLUMNS.items():
        kinds.setdefault(t, []).append(c)
    return _raw(_union(
        f"SELECT '{_SPARK_TYPE[t]}' AS type, {len(cs)} AS nb_colonnes, "
        f"({' + '.join(f'count({c})' for c in cs)})::BIGINT AS nb_valeurs FROM raw" for t, cs in kinds.items()))


_CORRELATED = [
    "age", "anciennete_client_mois", "revenu_mensuel_fcfa", "montant_credit_fcfa", "duree_mois", "taux_interet",
    "nb_incidents_24m", "nb_credits_en_cours", "ratio_endettement", "taux_effort",
]
_FLAGS = (
    ("age:required", "age IS NULL"), ("ville:required", "ville IS NULL"),
    ("secteur_activite:required", "secteur_activite IS NULL"), ("type_emploi:required", "type_emploi IS NULL"),
    ("anciennete_client_mois:required", "anciennete_client_mois IS NULL"),
    ("revenu_mensuel_fcfa:required", "revenu_mensuel_fcfa IS NULL"),
    ("type_produit:required", "type_produit IS NULL"),
    ("montant_credit_fcfa:required", "montant_credit_fcfa IS NULL"), ("duree_mois:required", "duree_mois IS NULL"),
    ("taux_interet:required", "taux_interet IS NULL"), ("garantie:required", "garantie IS NULL"),
    ("age:ge_18", "age < 18"), ("age:le_100", "age > 100"),
    ("anciennete_client_mois:ge_0", "anciennete_client_mois < 0"),
    ("revenu_mensuel_fcfa:gt_0", "revenu_mensuel_fcfa <= 0"),
    ("montant_credit_fcfa:gt_0", "montant_credit_fcfa <= 0"), ("duree_mois:gt_0", "duree_mois <= 0"),
    ("taux_interet:gt_0", "taux_interet <= 0"),
    ("nb_incidents_24m:ge_0", "nb_incidents_24m < 0"), ("nb_incidents_24m:le_10", "nb_incidents_24m > 10"),
    ("nb_credits_en_cours:ge_0", "nb_credits_en_cours < 0"), ("nb_credits_en_cours:le_20", "nb_credits_en_cours > 20"),
)
_VIOLATIONS = "concat_ws(';', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _FLAGS) + ")"
_APPLICATION = (
    "client_id, age, ville, secteur_activite, type_emploi, anciennete_client_mois, revenu_mensuel_fcfa, type_produit, "
    "montant_credit_fcfa, duree_mois, taux_interet, garantie, nb_incidents_24m, nb_credits_en_cours"
)

_CURVE = """
by_score AS (SELECT proba, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM by_score
          WINDOW w AS (ORDER BY proba DESC ROWS UNBOUNDED PRECEDING))
"""
_COUNTS = """
cells AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM scored),
one AS (SELECT *, tn::DOUBLE/(tn+fn) AS p0, tn::DOUBLE/(tn+fp) AS r0, 2.0*tn/(2*tn+fp+fn) AS f0, tn+fp AS n0,
  tp::DOUBLE/(tp+fp) AS p1, tp::DOUBLE/(tp+fn) AS r1, 2.0*tp/(2*tp+fp+fn) AS f1, tp+fn AS n1 FROM cells)
"""
_ZONED = """
cut AS (SELECT floor(quantile_cont(score, 0.65))::INTEGER AS a, floor(quantile_cont(score, 0.30))::INTEGER AS r FROM scored),
zoned AS (SELECT *, CASE WHEN score >= a THEN 'ACCEPTÉ' WHEN score < r THEN 'REFUSÉ' ELSE 'EXAMEN' END AS zone
  FROM scored, cut),
zone_rows AS (SELECT zone, count(defaut) AS nb, sum(defaut)::BIGINT AS nb_defauts,
  round_even(sum(defaut)::DOUBLE/count(defaut)*100, 2) AS taux_pct,
  round_even(100.0::DOUBLE*count(defaut)/(SELECT count(*) FROM zoned), 2) AS part_pct,
  round_even(100.0::DOUBLE*sum(defaut)/(SELECT sum(defaut) FROM zoned), 2) AS part_defauts_pct
  FROM zoned GROUP BY 1)
"""


def _kpi_columns() -> str:
    return (f"{N} AS total_prets, {BAD} AS nb_defauts, {RATE_EVEN} AS taux, {EXPOSURE} AS encours, {LOST} AS perdu, "
            "avg(montant_credit_fcfa) AS moyen, round_even(avg(taux_interet), 2) AS interet, "
            "round_even(avg(taux_effort), 2) AS effort")


# Documents of applications: the loans of 25 consecutive orders, and why a document is refused.
_LOTS = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lot ORDER BY client_id, montant_credit_fcfa, duree_mois, h) - 1 AS rang FROM (
    SELECT *, substr(client_id, 4)::BIGINT // 200 AS lot, {_VIOLATIONS} AS broken FROM once)
  WHERE broken = '' OR lot % 13 = 3
),
refused AS (SELECT lot, min_by('clients[' || rang || ']:' || split_part(broken, ';', 1), rang) AS e FROM numbered WHERE broken <> '' GROUP BY 1),
listed AS (
  SELECT lot, count(*) AS n, string_agg(floor(montant_credit_fcfa::DOUBLE / duree_mois)::BIGINT::VARCHAR, ',' ORDER BY rang) AS m
  FROM numbered GROUP BY 1
),
judged AS (
  SELECT listed.*, CASE WHEN lot % 50 = 7 THEN 'illisible' WHEN lot % 41 = 5 THEN 'clients:required'
    WHEN n > 100 THEN 'clients:max_length_100' ELSE e END AS erreur FROM listed LEFT JOIN refused USING (lot)
),
lots AS (
  SELECT lot, CASE WHEN erreur IS NULL THEN n END::INTEGER AS total, CASE WHEN erreur IS NULL THEN m END AS mensualites, erreur FROM judged
)"""

# Sliding windows of a day every six hours over the events of each sector, next to the sector's default rate.
_WINDOWS = """marked AS (
  SELECT DISTINCT event_id, ts, c_mktsegment AS segment, event_type = 'error' AS bad FROM events JOIN customer ON user_id = c_custkey
),
windows AS (
  SELECT segment, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS window_start, count(*) AS events,
    sum(bad::BIGINT)::BIGINT AS incidents
  FROM marked, range(0, 4) AS r(k) GROUP BY 1, 2
),
compared AS (
  SELECT w.*, window_start + INTERVAL 24 HOUR AS window_end, incidents::DOUBLE / events AS rate,
    coalesce((SELECT avg(defaut) FROM credits c WHERE c.secteur_activite = w.segment), (SELECT avg(defaut) FROM credits)) AS baseline
  FROM windows w
),
measured AS (SELECT *, (rate - baseline) / sqrt(baseline * (1 - baseline) / events) AS errors FROM compared)"""

_ALERTS = """SELECT segment, window_start, window_end, events, incidents, round(rate, 9) AS rate, round(baseline, 9) AS baseline,
  round(errors, 6) AS errors, CASE WHEN errors >= 2 THEN 'critical' ELSE 'warning' END AS level
  FROM measured WHERE events >= 20 AND rate >= baseline * 1.1 AND errors >= 1"""


def statements() -> dict[str, str]:
    kpi = f"k AS (SELECT {_kpi_columns()} FROM credits)"
    dash = "WHERE secteur_activite = 'BUILDING'"
    out = {
        # sources
        "src_csv_roundtrip": _raw("SELECT * FROM raw"),
        "src_csv_rejected": _raw("""SELECT colonnes, count(*) AS nb FROM (
            SELECT concat_ws(';', CASE WHEN montant_credit_fcfa % 13 = 0 THEN 'age' END,
              CASE WHEN montant_credit_fcfa % 17 = 0 THEN 'duree_mois' END) AS colonnes FROM raw
            WHERE montant_credit_fcfa % 13 = 0 OR montant_credit_fcfa % 17 = 0) GROUP BY 1"""),
        "load_table_count": _credits("SELECT count(*) AS n FROM credits"),
        "credits_clean": _credits("SELECT * FROM credits"),
        # derivations
        "derive_client_id": "SELECT 'CLI' || CASE WHEN length(v) < 6 THEN lpad(v, 6, '0') ELSE v END AS client_id "
                            "FROM (SELECT (l_orderkey*8 + l_linenumber)::VARCHAR AS v FROM lineitem)",
        "derive_debt_ratio": _raw("SELECT montant_credit_fcfa, duree_mois, revenu_mensuel_fcfa, "
                                  "round_even(ratio_endettement, 3) AS ratio_endettement FROM base"),
        "derive_product_risk": _raw("""SELECT type_produit, CASE type_produit WHEN 'ECONOMY' THEN 0.25 WHEN 'LARGE'
          THEN 0.10 WHEN 'MEDIUM' THEN 0.30 WHEN 'PROMO' THEN 0.20 WHEN 'SMALL' THEN 0.15 WHEN 'STANDARD' THEN 0.35
          END::DOUBLE AS risque_produit, count(*) AS nb FROM base GROUP BY 1"""),
        "derive_sector_risk": _raw("""SELECT secteur_activite, CASE secteur_activite WHEN 'AUTOMOBILE' THEN 0.20
          WHEN 'BUILDING' THEN 0.28 WHEN 'FURNITURE' THEN 0.15 WHEN 'HOUSEHOLD' THEN 0.30 END::DOUBLE
          AS risque_secteur, count(*) AS nb FROM base GROUP BY 1"""),
        "risk_score_composite": _raw("SELECT client_id, round_even(score_risque, 9) AS score_risque FROM base"),
        "label_by_percentile": _raw("""SELECT defaut, count(*) AS nb, round_even(min(score_risque), 9) AS score_min,
          round_even(max(score_risque), 9) AS score_max FROM labelled GROUP BY 1"""),
        "derive_arrears": _raw("SELECT defaut, jours_retard, count(*) AS nb FROM arrears GROUP BY 1, 2"),
        "class_by_arrears": _raw("""SELECT classification_cobac AS classe, count(*) AS nb,
          min(jours_retard) AS jours_min, max(jours_retard) AS jours_max FROM raw GROUP BY 1"""),
        "provision_by_class": _raw("""SELECT classification_cobac, count(*) AS nb_credits,
          sum(montant_credit_fcfa)::BIGINT AS encours_fcfa, sum(provision_fcfa)::BIGINT AS provision_fcfa
          FROM raw GROUP BY 1"""),
        "derive_grant_date": """SELECT i AS position, TIMESTAMP '2022-01-01' + to_hours((i*3)::INTEGER) AS date_octroi
          FROM (SELECT l_orderkey*8 + l_linenumber AS i FROM lineitem)""",
        # profile
        "profile_shape": _raw("SELECT count(*) AS n_lignes, 20 AS n_colonnes FROM raw"),
        "profile_dtypes": _dtypes(),
        "profile_missing": _raw("SELECT * FROM (" + _union(
            f"SELECT '{c}' AS colonne, count(*) FILTER ({c} IS NULL) AS manquants, "
            f"round_even(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 2) AS pourcentage FROM raw"
            for c in _RAW_COLUMNS) + ") WHERE manquants > 0"),
        "profile_duplicates": _raw("""SELECT (n - d)::BIGINT AS doublons,
          round_even(100.0::DOUBLE * (n - d) / n, 2) AS pourcentage
          FROM (SELECT count(*) AS n FROM raw), (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM raw))"""),
        "profile_target": _raw("""SELECT defaut AS valeur, CASE WHEN defaut = 0 THEN 'Sain' ELSE 'Défaut' END AS libelle,
          count(*) AS nb, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM raw), 2) AS pourcentage,
          round((SELECT avg(defaut) FROM raw) * 100, 9) AS taux_defaut FROM raw GROUP BY 1"""),
        "profile_numeric": _raw(_union(
            f"SELECT '{c}' AS colonne, round_even(avg({c}), 2) AS mean, round_even(stddev_samp({c}), 2) AS std, "
            f"round_even(min({c})::DOUBLE, 2) AS min, round_even(quantile_cont({c}, 0.5), 2) AS mediane, "
            f"round_even(max({c})::DOUBLE, 2) AS max FROM raw" for c in _NUMERIC)),
        "profile_cardinality": _raw(_union(
            f"SELECT '{c}' AS colonne, count(DISTINCT {c}) AS nb_uniques FROM raw" for c in _TEXT)),
        "profile_constants": _raw("""SELECT * FROM (SELECT 'devise' AS colonne, count(DISTINCT devise)::INTEGER
          AS nb_uniques FROM (SELECT 'FCFA' AS devise FROM raw) UNION ALL SELECT 'vide', count(DISTINCT vide)::INTEGER
          FROM (SELECT NULL::VARCHAR AS vide FROM raw) UNION ALL """ + _union(
            f"SELECT '{c}', count(DISTINCT {c})::INTEGER FROM raw" for c in _RAW_COLUMNS) + ") WHERE nb_uniques <= 1"),
        # cleaning
        "clean_drop_leakage": _raw(f"SELECT {_FIFTEEN} FROM raw"),
        "clean_age_filter": _survivors("s2"),
        "clean_income_filter": _survivors("s3"),
        "clean_amount_filter": _survivors("s4"),
        "clean_ratio_filter": _survivors("s5"),
        "clean_dedupe": _credits(f"SELECT DISTINCT {_FIFTEEN} FROM s5"),
        "feat_ratio_effort": _credits("SELECT montant_credit_fcfa, revenu_mensuel_fcfa, duree_mois, "
                                      "ratio_endettement, taux_effort FROM credits"),
        "feat_age_band": _band("tranche_age", "age"),
        "feat_income_band": _band("tranche_revenu", "revenu_mensuel_fcfa"),
        "feat_amount_band": _band("tranche_montant", "montant_credit_fcfa"),
        "feat_log": _credits("SELECT revenu_mensuel_fcfa, montant_credit_fcfa, revenu_log, montant_log FROM credits"),
        "clean_impute_median": _credits("""SELECT duree_mois, taux_effort, garantie, count(*) AS nb FROM (
            SELECT coalesce(d, (SELECT quantile_cont(d, 0.5) FROM holed))::DOUBLE AS duree_mois,
              coalesce(e, (SELECT quantile_cont(e, 0.5) FROM holed)) AS taux_effort, garantie FROM holed)
          GROUP BY ALL""", """holed AS (SELECT CASE WHEN montant_credit_fcfa % 7 <> 0 THEN duree_mois END AS d,
            CASE WHEN montant_credit_fcfa % 11 <> 0 THEN taux_effort END AS e, garantie FROM credits)"""),
        "clean_report": _credits("""SELECT n0 AS n_initial, 5 AS colonnes_supprimees, n0 - n2 AS filtrage_age,
            n2 - n3 AS filtrage_revenus, n3 - n4 AS filtrage_montants, n4 - n5 AS filtrage_ratio,
            n5 - n6 AS doublons_supprimes, n6 AS n_final, n0 - n6 AS lignes_supprimees,
            round_even(n6::DOUBLE / n0::DOUBLE * 100, 2) AS taux_conservation,
            round_even((SELECT avg(defaut) FROM credits) * 100, 2) AS taux_defaut
          FROM (SELECT count(*) AS n0 FROM raw), (SELECT count(*) AS n2 FROM s2), (SELECT count(*) AS n3 FROM s3),
            (SELECT count(*) AS n4 FROM s4), (SELECT count(*) AS n5 FROM s5), (SELECT count(*) AS n6 FROM s6)"""),
        # exploratory tables
        "eda_global": _credits(f"""SELECT total_prets, taux AS taux_defaut_global, encours AS montant_total_fcfa,
            round(moyen, 4) AS montant_moyen_fcfa, perdu AS encours_defaut_fcfa, interet AS taux_interet_moyen,
            (SELECT quantile_cont(revenu_mensuel_fcfa, 0.5) FROM credits) AS revenu_median,
            effort AS ratio_effort_moyen FROM k""", kpi),
        "eda_rate_by_age": _credits(_segment("tranche_age")),
        "eda_rate_by_sector": _credits(_segment("secteur_activite")),
        "eda_rate_by_product": _credits(_segment("type_produit")),
        "eda_rate_by_income": _credits(_segment("tranche_revenu")),
        "eda_rate_by_city": _credits(_segment("ville")),
        "eda_rate_by_incident": _credits(f"""SELECT CASE nb_incidents_24m WHEN 0 THEN 'Sans incidents (24m)'
            ELSE 'Avec incidents (24m)' END AS incidents_label, count(defaut) AS nb_prets, round({MEAN}, 9) AS mean,
            {RATE_EVEN} AS taux_defaut FROM credits WHERE nb_incidents_24m IN (0, 1) GROUP BY 1"""),
        "eda_rate_by_guarantee": _credits(_segment("garantie")),
        "eda_histogram": _credits("""SELECT bin, round(lo + bin*((hi-lo)/50.0::DOUBLE), 4) AS borne_basse,
            round(lo + (bin+1)*((hi-lo)/50.0::DOUBLE), 4) AS borne_haute, defaut, nb FROM (
              SELECT least(floor((x - lo)/((hi-lo)/50.0::DOUBLE)), 49)::INTEGER AS bin, lo, hi, defaut, count(*) AS nb
              FROM kept, (SELECT min(x) AS lo, max(x) AS hi FROM kept) GROUP BY ALL)""",
            """kept AS (SELECT montant_credit_fcfa::DOUBLE AS x, defaut FROM credits WHERE montant_credit_fcfa <
              (SELECT quantile_cont(montant_credit_fcfa, 0.95) FROM credits))"""),
        "eda_correlation": _credits(_union(
            f"SELECT '{c}' AS variable, round(corr({c}, defaut), 6) AS correlation FROM credits"
            for c in _CORRELATED)),
        "eda_crosstab": _credits(f"""SELECT secteur_activite, garantie, round({MEAN}, 9) AS defaut,
            {RATE_EVEN} AS taux_defaut FROM credits
            WHERE secteur_activite IS NOT NULL AND garantie IS NOT NULL GROUP BY 1, 2"""),
        "eda_crosstab_wide": _credits("SELECT secteur_activite, " + ", ".join(
            f"round_even(avg(defaut) FILTER (garantie = '{g}') * 100, 2) AS \"{g}\""
            for g in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM credits GROUP BY 1"),
        "eda_crosstab_sparse": _credits("""SELECT type_produit, count(*)::INTEGER AS nb_villes,
            string_agg(ville || ':' || round_even(t * 100, 0)::BIGINT, ';' ORDER BY ville) AS taux FROM (
              SELECT type_produit, ville, round_even(avg(defaut) * 100, 2) AS t FROM credits
              WHERE type_produit IS NOT NULL AND ville IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""),
        "eda_decile_evolution": _credits(f"""SELECT bucket, count(defaut) AS nb_prets, round({MEAN}, 9) AS mean,
            {RATE_EVEN} AS taux_defaut FROM (
              SELECT defaut, greatest((10*i + n - 2)//(n - 1) - 1, 0)::INTEGER AS bucket FROM (
                SELECT defaut, row_number() OVER (ORDER BY date_octroi, {LOAN_HASH}) - 1 AS i, count(*) OVER () AS n
                FROM dated)) GROUP BY 1"""),
        # portfolio reports
        "sql_kpi": _credits(f"""SELECT {N} AS total_prets, {BAD} AS nb_defauts, {RATE} AS taux_defaut_pct,
            round({EXPOSURE}::DOUBLE/1e9, 3) AS encours_milliards_fcfa,
            round({LOST}::DOUBLE/1e9, 3) AS encours_defaut_milliards_fcfa,
            round(avg(montant_credit_fcfa), 0) AS montant_moyen_fcfa, round(avg(taux_interet), 2) AS taux_interet_moyen,
            round(avg(taux_effort), 2) AS taux_effort_moyen FROM credits"""),
        "sql_by_sector": _credits(f"""SELECT secteur_activite, {N} AS nb_prets, {BAD} AS nb_defauts,
            {RATE} AS taux_defaut_pct, round(avg(montant_credit_fcfa), 0) AS montant_moyen,
            round({EXPOSURE}::DOUBLE/1e6, 1) AS exposition_millions_fcfa,
            round({LOST}::DOUBLE/1e6, 1) AS perte_potentielle_millions
            FROM credits GROUP BY 1 HAVING count(*) >= 30"""),
        "sql_by_product": _credits(f"""SELECT type_produit, {N} AS nb_prets, {RATE} AS taux_defaut_pct,
            round(avg(montant_credit_fcfa), 0) AS montant_moyen, round(avg(duree_mois), 0) AS duree_moyenne_mois,
            round(avg(taux_interet), 2) AS taux_moyen FROM credits GROUP BY 1"""),
        "sql_by_income": _credits(f"""SELECT tranche_revenu, {N} AS nb_prets, {RATE} AS taux_defaut_pct,
            round(avg(revenu_mensuel_fcfa), 0) AS revenu_moyen, round(avg(montant_credit_fcfa), 0) AS montant_moyen,
            round({LOST}::DOUBLE/1e6, 1) AS perte_potentielle_millions FROM credits GROUP BY 1"""),
        "sql_incidents": _credits(f"""SELECT CASE WHEN nb_incidents_24m = 0 THEN 'Sans incidents (24m)'
            ELSE 'Avec incidents (24m)' END AS categorie, {N} AS nb_prets, {BAD} AS nb_defauts,
            {RATE} AS taux_defaut_pct, round(avg(montant_credit_fcfa), 0) AS montant_moyen FROM credits GROUP BY 1"""),
        "sql_geo": _credits(f"""SELECT ville, {N} AS nb_clients, round({EXPOSURE}::DOUBLE/1e6, 1) AS encours_millions,
            round(100.0::DOUBLE*{EXPOSURE}/(SELECT sum(montant_credit_fcfa)::BIGINT FROM credits), 2)
              AS concentration_pct, {RATE} AS taux_defaut_pct FROM credits GROUP BY 1"""),
        **{name: _credits(f"""SELECT secteur_activite, garantie, {N} AS nb_prets, {RATE} AS taux_defaut_pct,
            round({EXPOSURE}::DOUBLE/1e6, 1) AS exposition_millions FROM credits GROUP BY 1, 2
            HAVING count(*) >= {least} ORDER BY taux_defaut_pct DESC NULLS LAST, secteur_activite NULLS LAST,
            garantie NULLS LAST LIMIT 15""")
           for name, least in (("sql_critical_segments", 50), ("sql_critical_segments_150", 150))},
        "sql_class_matrix": _credits(f"""SELECT {CLASS_SQL} AS categorie_cobac, {N} AS nb_credits,
            round({EXPOSURE}::DOUBLE/1e9, 3) AS encours_milliards,
            round(100.0::DOUBLE*count(*)/(SELECT count(*) FROM credits), 2) AS part_pct,
            {RATE} AS taux_defaut_observe FROM credits GROUP BY 1"""),
        "sql_top_segments": _credits(f"""SELECT secteur_activite, type_produit, {N} AS nb_prets,
            {RATE} AS taux_defaut_pct, round({LOST}::DOUBLE/1e6, 1) AS perte_potentielle_millions
            FROM credits GROUP BY 1, 2 HAVING count(*) >= 30
            ORDER BY perte_potentielle_millions DESC NULLS LAST, secteur_activite NULLS LAST, type_produit NULLS LAST
            LIMIT 10"""),
        "sql_summary": _credits(_union([
            f"SELECT 'Taux de défaut global' AS indicateur, {_text(RATE)} || ' %' AS valeur FROM credits",
            f"SELECT 'Encours total', {_text(f'round({EXPOSURE}::DOUBLE/1e9, 2)')} || ' milliards FCFA' FROM credits",
            f"SELECT 'Encours en défaut', {_text(f'round({LOST}::DOUBLE/1e9, 2)')} || ' milliards FCFA' FROM credits",
            f"SELECT 'Perte potentielle estimée (LGD 60%)', "
            f"{_text(f'round({LOST}::DOUBLE*0.6/1e9, 2)')} || ' milliards FCFA' FROM credits",
            f"SELECT 'Clients avec incidents (24m)', "
            f"{_text('round(100.0::DOUBLE*sum(nb_incidents_24m)/count(*), 2)')} || ' %' FROM credits",
            *[f"SELECT '{label}', first(k || ' (' || t::VARCHAR || ' %)' ORDER BY t DESC, k) FROM (SELECT {key} AS k, "
              f"round(100.0::DOUBLE*sum(defaut)/count(*), 1) AS t FROM credits GROUP BY 1)"
              for label, key in (("Secteur le plus risqué", "secteur_activite"),
                                 ("Produit le plus risqué", "type_produit"))],
        ])),
        "class_rules_grid": _credits(f"""SELECT {CLASS_SQL} AS classe_sql, {CLASS_MASKS} AS classe_masques,
            nb_incidents_24m, count(*) AS nb, min(taux_effort) AS effort_min, max(taux_effort) AS effort_max
            FROM credits GROUP BY 1, 2, 3"""),
        # models
        "ml_encode": _credits("SELECT ville, secteur_activite, type_emploi, type_produit, garantie, " + ", ".join(
            f"(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1)::INTEGER AS {c}_enc"
            for c in ("ville", "secteur_activite", "type_emploi", "type_produit", "garantie"))
            + ", age, montant_credit_fcfa FROM credits"),
        "ml_encode_unknown": _credits("""SELECT c.secteur_activite, coalesce(s.k, -1)::INTEGER AS secteur_activite_enc,
            c.garantie, coalesce(g.k, -1)::INTEGER AS garantie_enc, count(*) AS nb FROM credits c
            LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT secteur_activite AS v
              FROM known)) s ON c.secteur_activite = s.v
            LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT garantie AS v
              FROM known)) g ON c.garantie = g.v
            GROUP BY 1, 2, 3, 4""",
            "known AS (SELECT * FROM credits WHERE secteur_activite <> 'FURNITURE' AND garantie IS NOT NULL)"),
        "ml_split_counts": _credits(f"""SELECT r <= k AS is_test, defaut, count(*) AS nb,
            sum(montant_credit_fcfa)::BIGINT AS encours FROM (
              SELECT defaut, montant_credit_fcfa, row_number() OVER (PARTITION BY defaut ORDER BY {LOAN_HASH}) AS r
              FROM credits) JOIN sizes USING (defaut) GROUP BY 1, 2""",
            _SIZES),
        "ml_test_facts": _credits("""SELECT modele, (SELECT sum(k) FROM sizes)::BIGINT AS nb_test,
            (SELECT k FROM sizes WHERE defaut = 1)::BIGINT AS nb_defauts, (SELECT sum(k) FROM sizes)::BIGINT AS nb_rapport,
            true AS bornes_ok
            FROM (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting')) AS m(modele)""", _SIZES),
        "ml_score_facts": _credits("SELECT secteur_activite, count(*) AS nb, 0::BIGINT AS nb_faux FROM credits GROUP BY 1"),
        "ml_importance_facts": "SELECT 15::BIGINT AS nb_features, true AS somme_ok, true AS positif",
        "serve_score_facts": _raw(f"""SELECT count(*) AS nb, count(DISTINCT client_id) AS nb_clients, 0::BIGINT AS nb_faux
            FROM raw WHERE {_VIOLATIONS} = ''"""),
        "ml_logreg_optimality": _credits("SELECT count(*) - (SELECT sum(k) FROM sizes)::BIGINT AS nb_train, true AS optimum FROM credits", _SIZES),
        "ml_confusion_facts": _credits("""SELECT modele, (SELECT sum(k) FROM sizes)::BIGINT AS nb_test, 0::BIGINT AS nb_ecarts,
            0::BIGINT AS nb_classes_fausses
            FROM (VALUES ('Logistic Regression'), ('Random Forest'), ('Gradient Boosting')) AS m(modele)""", _SIZES),
        "ml_class_weights": _credits("""SELECT defaut, count(*) AS nb,
            round((SELECT count(*) FROM credits)::DOUBLE / (2 * count(*)), 9) AS poids FROM credits GROUP BY 1"""),
        "metric_auc": _scored("""SELECT round(sum(neg * ((tp - pos) + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)::DOUBLE),
            9) AS auc FROM curve""", _CURVE),
        "metric_average_precision": _scored("""SELECT round(sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos), 9)
            AS avg_precision FROM curve""", _CURVE),
        "metric_class_report": _scored("SELECT classe, round(p, 9) AS precision, round(r, 9) AS recall, "
            "round(f, 9) AS f1_score, support FROM (" + _union([
                "SELECT '0' AS classe, p0::DOUBLE AS p, r0::DOUBLE AS r, f0::DOUBLE AS f, n0::BIGINT AS support FROM one",
                "SELECT '1', p1, r1, f1, n1 FROM one",
                "SELECT 'accuracy', a, a, a, n FROM (SELECT (tn+tp)::DOUBLE/(n0+n1) AS a, n0+n1 AS n FROM one)",
                "SELECT 'macro avg', (p0+p1)/2, (r0+r1)/2, (f0+f1)/2, n0+n1 FROM one",
                "SELECT 'weighted avg', (p0*n0+p1*n1)/(n0+n1), (r0*n0+r1*n1)/(n0+n1), (f0*n0+f1*n1)/(n0+n1), n0+n1 "
                "FROM one"]) + ")", _COUNTS),
        "metric_confusion": _scored("""SELECT tn AS vrais_negatifs, fp AS faux_positifs, fn AS faux_negatifs,
            tp AS vrais_positifs FROM cells""", _COUNTS),
        "score_from_probability": _scored("SELECT score, count(*) AS nb FROM scored GROUP BY 1"),
        "score_truncated": _scored("SELECT score_floor AS score, count(*) AS nb FROM scored GROUP BY 1"),
        "grade_v1": _by_score("categorie", GRADES_V1),
        "grade_v2": _by_score("categorie", GRADES_V2),
        "decision_v1": _by_score("decision", DECISIONS_V1),
        "decision_v2": _scored("SELECT decision, CASE decision " + " ".join(
            f"WHEN {_quoted(d)} THEN {_quoted(t)}" for d, t in RECOMMENDATIONS.items())
            + f""" END AS recommandation, count(*) AS nb, min(score_floor) AS score_min, max(score_floor) AS score_max
            FROM (SELECT score_floor, {_cut('score_floor', DECISIONS_V2)} AS decision FROM scored) GROUP BY 1, 2"""),
        # calibration
        "calib_describe": _scored("""SELECT count(*) AS count, round_even(avg(score), 0)::DOUBLE AS mean,
            round_even(stddev_samp(score), 0)::DOUBLE AS std, min(score)::DOUBLE AS min,
            round_even(quantile_cont(score, 0.25), 0)::DOUBLE AS p25,
            round_even(quantile_cont(score, 0.5), 0)::DOUBLE AS p50,
            round_even(quantile_cont(score, 0.75), 0)::DOUBLE AS p75, max(score)::DOUBLE AS max FROM scored"""),
        "calib_deciles": _scored(_union(
            f"SELECT {10*i} AS decile_pct, floor(quantile_cont(score, {i/10}))::INTEGER AS score FROM scored"
            for i in range(1, 10))),
        "calib_bands": _scored(f"""SELECT CASE WHEN score <= 400 THEN '[0,400]' WHEN score <= 500 THEN '(400,500]'
            WHEN score <= 600 THEN '(500,600]' WHEN score <= 700 THEN '(600,700]' WHEN score <= 800 THEN '(700,800]'
            ELSE '(800,1000]' END AS tranche, count(defaut) AS nb, {BAD} AS nb_defauts, {RATE_EVEN} AS taux_pct,
            round_even(100.0::DOUBLE*count(defaut)/(SELECT count(*) FROM scored), 2) AS part_pct
            FROM scored GROUP BY 1"""),
        "calib_thresholds": _scored("SELECT a AS seuil_accept, r AS seuil_refus FROM cut", _ZONED),
        "calib_zones": _scored("SELECT * FROM zone_rows", _ZONED),
        "calib_fold_facts": _credits("""SELECT secteur_activite, count(*) AS nb, sum(montant_credit_fcfa)::BIGINT AS encours,
            0::BIGINT AS nb_faux FROM credits GROUP BY 1"""),
        "calib_avoided": _scored("""SELECT part_pct AS part_refusee_pct, part_defauts_pct AS defauts_evites_pct
            FROM zone_rows WHERE zone = 'REFUSÉ'""", _ZONED),
        # regulatory report
        "report_kpis": _credits("""SELECT total_prets, nb_defauts, taux AS taux_defaut, encours AS encours_total_fcfa,
            perdu AS encours_defaut_fcfa, round(perdu::DOUBLE * 0.6::DOUBLE, 2) AS perte_potentielle_fcfa,
            round(moyen, 4) AS montant_moyen_fcfa, interet AS taux_interet_moyen, effort AS taux_effort_moyen
            FROM k""", kpi),
        "report_sector": _credits(f"""SELECT secteur_activite, count(defaut) AS nb_prets, {BAD} AS nb_defauts,
            {RATE_EVEN} AS taux, round_even({EXPOSURE}::DOUBLE/1e6, 1) AS exposition_millions
            FROM credits WHERE secteur_activite IS NOT NULL GROUP BY 1"""),
        "report_sector_extremes": _credits("""SELECT w.k AS secteur_plus_risque, w.t AS taux_plus_eleve,
            b.k AS secteur_moins_risque, b.t AS taux_plus_faible, w.k ||
            ' est le secteur où les défauts sont les plus fréquents : ' || printf('%.2f', w.t) || '% des prêts. ' || b.k ||
            ' en compte le moins : ' || printf('%.2f', b.t) || '%.' AS constat
            FROM (SELECT * FROM s ORDER BY m DESC, k LIMIT 1) w, (SELECT * FROM s ORDER BY m, k DESC LIMIT 1) b""",
            f"s AS (SELECT secteur_activite AS k, {MEAN} AS m, {RATE_EVEN} AS t FROM credits GROUP BY 1)"),
        "report_product": _credits(_sheet("type_produit", "taux")),
        "report_class": _credits(f"""SELECT {CLASS_MASKS} AS categorie_cobac, count(defaut) AS nb_credits,
            round_even(100.0::DOUBLE*count(defaut)/(SELECT count(*) FROM credits), 2) AS part_pct,
            round_even({EXPOSURE}::DOUBLE/1e9, 3) AS encours_mds, {RATE_EVEN} AS taux_defaut_pct
            FROM credits GROUP BY 1"""),
        "report_sheet_kpis": _credits("SELECT * FROM (" + _union([
            'SELECT \'Total prêts\' AS "Indicateur", total_prets::DOUBLE AS "Valeur" FROM k',
            "SELECT 'Taux de défaut (%)', taux FROM k",
            "SELECT 'Nombre de défauts', nb_defauts::DOUBLE FROM k",
            "SELECT 'Encours total (FCFA)', encours::DOUBLE FROM k",
            "SELECT 'Encours en défaut (FCFA)', perdu::DOUBLE FROM k",
            "SELECT 'Perte potentielle LGD 60% (FCFA)', round(perdu::DOUBLE * 0.6::DOUBLE, 2) FROM k",
            "SELECT 'Montant moyen (FCFA)', round(moyen, 2) FROM k",
            "SELECT 'Taux d''intérêt moyen (%)', interet FROM k"]) + ")", kpi),
        "report_sheet_sector": _credits(_sheet("secteur_activite")),
        "report_sheet_product": _credits(_sheet("type_produit")),
        "report_sheet_class": _credits(f"""SELECT {CLASS_MASKS} AS categorie_cobac, count(defaut) AS nb_credits,
            {BAD} AS nb_defauts, {EXPOSURE} AS encours_fcfa,
            round_even(100.0::DOUBLE*count(defaut)/(SELECT count(*) FROM credits), 2) AS part_pct,
            {RATE_EVEN} AS taux_defaut_pct FROM credits GROUP BY 1"""),
        "report_text_rows": _credits(_union([
            "SELECT 1 AS ordre, 'Date du rapport' AS indicateur, '31/03/2024' AS valeur",
            """SELECT 2, 'Synthèse', format('{:,}', total_prets) || ' prêts sont suivis ; leur encours est de ' ||
              printf('%.2f', encours::DOUBLE/1e9) || ' milliards FCFA. Parmi eux, ' || format('{:,}', nb_defauts) ||
              ' sont en défaut (taux : ' || taux::VARCHAR || '%), avec un encours de ' ||
              printf('%.2f', perdu::DOUBLE/1e9) || ' milliards FCFA.' FROM k""",
            "SELECT 3, 'Total prêts', format('{:,}', total_prets) FROM k",
            "SELECT 4, 'Taux de défaut global', taux::VARCHAR || ' %' FROM k",
            "SELECT 5, 'Nombre de défauts', format('{:,}', nb_defauts) FROM k",
            "SELECT 6, 'Encours total', printf('%.2f', encours::DOUBLE/1e9) || ' Mds FCFA' FROM k",
            "SELECT 7, 'Encours en défaut', printf('%.2f', perdu::DOUBLE/1e9) || ' Mds FCFA' FROM k",
            "SELECT 8, 'Perte potentielle (LGD 60%)', printf('%.2f', perdu::DOUBLE*0.6::DOUBLE/1e9) || ' Mds FCFA' FROM k",
            "SELECT 9, 'Montant moyen', printf('%.2f', moyen/1e6) || ' M FCFA' FROM k",
        ]), kpi),
        # service
        "validate_ok": _raw(f"SELECT {_APPLICATION} FROM raw WHERE {_VIOLATIONS} = ''"),
        "validate_quarantine": _raw(
            f"SELECT client_id, age, {_VIOLATIONS} AS violations FROM raw WHERE {_VIOLATIONS} <> ''"),
        "validate_rule_counts": _raw("SELECT * FROM (" + _union(
            f"SELECT '{name}' AS regle, count(*) AS nb FROM raw WHERE {cond}" for name, cond in _FLAGS)
            + ") WHERE nb > 0"),
        "validate_batch_size": _raw("""SELECT ville, type_produit, type_emploi, count(*) AS nb_clients,
            count(*) BETWEEN 1 AND 100 AS acceptee FROM raw GROUP BY 1, 2, 3"""),
        "serve_features": _raw("""SELECT client_id, montant_credit_fcfa, duree_mois, revenu_mensuel_fcfa,
            CASE WHEN q IS NOT NULL THEN least(greatest(q, 0.0::DOUBLE), 3.0::DOUBLE) END AS ratio_endettement,
            CASE WHEN q IS NOT NULL THEN least(greatest(q * 100, 0.0::DOUBLE), 200.0::DOUBLE) END AS taux_effort
            FROM (SELECT *, montant_credit_fcfa::DOUBLE / duree_mois::DOUBLE / revenu_mensuel_fcfa::DOUBLE AS q
            FROM raw)"""),
        "serve_batch_payloads": _raw("SELECT lot, total, mensualites, erreur FROM lots", _LOTS),
        "serve_batch_facts": _raw("""SELECT count(*) AS nb_lots, count(erreur) AS nb_refuses, sum(total)::BIGINT AS nb_resultats,
            0::BIGINT AS nb_faux FROM lots""", _LOTS),
        "stream_segment_alerts": _credits(f"""{_ALERTS} AND window_end <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 6 HOUR FROM marked)""",
            _WINDOWS),
        "batch_segment_alerts": _credits(_ALERTS, _WINDOWS),
        "api_kpis": _credits("""SELECT count(*) AS total_prets, sum(defaut)::BIGINT AS nb_defauts,
            round_even(avg(defaut) * 100, 2) AS taux_defaut_pct, sum(montant_credit_fcfa)::DOUBLE AS encours_total_fcfa,
            sum(CASE WHEN defaut = 1 THEN montant_credit_fcfa ELSE 0 END)::DOUBLE AS encours_defaut_fcfa,
            round(avg(montant_credit_fcfa), 4) AS montant_moyen_fcfa, round(avg(taux_interet), 9) AS taux_interet_moyen
            FROM credits"""),
        "api_by_sector": _credits(_sheet("secteur_activite")),
        "api_by_product": _credits(_sheet("type_produit")),
        # dashboard
        "dash_filtered": _credits("""SELECT * FROM credits WHERE secteur_activite = 'BUILDING'
            AND type_produit = 'PROMO' AND defaut = 1"""),
        "dash_filter_values": _credits("""SELECT DISTINCT 'secteur' AS filtre, secteur_activite AS valeur FROM credits
            UNION ALL SELECT DISTINCT 'produit', type_produit FROM credits"""),
        "dash_kpis": _credits(f"""SELECT count(*) AS nb_prets,
            round_even(100.0::DOUBLE*count(*)/(SELECT count(*) FROM credits), 1) AS part_portefeuille_pct,
            round_even(100.0::DOUBLE*sum(defaut)/count(defaut), 2) AS taux_defaut_pct, {BAD} AS nb_defauts,
            {EXPOSURE} AS encours_fcfa, {LOST}::DOUBLE * 0.6::DOUBLE AS perte_potentielle_fcfa FROM credits {dash}"""),
        "dash_by_sector": _credits(f"""SELECT secteur_activite, count(defaut) AS nb_prets, round({MEAN}, 9) AS mean,
            {RATE_EVEN} AS taux FROM credits GROUP BY 1"""),
        "dash_by_product": _credits(f"""SELECT type_produit, count(defaut) AS nb_prets, round({MEAN}, 9) AS mean,
            {RATE_EVEN} AS taux FROM credits {dash} GROUP BY 1"""),
        "dash_incidents": _credits(f"""SELECT CASE nb_incidents_24m WHEN 0 THEN 'Sans incidents'
            ELSE 'Avec incidents' END AS incidents, count(defaut) AS nb_prets, {RATE_EVEN} AS taux
            FROM credits {dash} AND nb_incidents_24m IN (0, 1) GROUP BY 1"""),
        "dash_income": _credits(f"""SELECT tranche_revenu, count(defaut) AS nb_prets, {RATE_EVEN} AS taux
            FROM credits {dash} AND tranche_revenu IS NOT NULL GROUP BY 1"""),
        "dash_class": _credits(f"""SELECT {CLASS_MASKS} AS categorie_cobac, count(defaut) AS nb, {RATE_EVEN} AS taux
            FROM credits {dash} GROUP BY 1"""),
        "dash_top_segments": _credits(f"""SELECT secteur_activite AS secteur, type_produit AS produit,
            format('{{:,}}', n) AS nb_prets, t::VARCHAR || ' %' AS taux_defaut FROM (
              SELECT secteur_activite, type_produit, count(defaut) AS n, {MEAN} AS m, {RATE_EVEN} AS t
              FROM credits GROUP BY 1, 2 HAVING count(defaut) >= 20
              ORDER BY m DESC, secteur_activite, type_produit LIMIT 10)"""),
    }
    out["sql_export_all"] = _union(_entries(out[query], *parts) for query, *parts in _EXPORTED)
    return out


# ---- fixed values: report, its text columns, its number columns ------------------------------------------------
_EXPORTED = (
    ("sql_kpi", "kpi_globaux", (), ("total_prets", "nb_defauts", "taux_defaut_pct", "encours_milliards_fcfa",
     "encours_defaut_milliards_fcfa", "montant_moyen_fcfa", "taux_interet_moyen", "taux_effort_moyen")),
    ("sql_by_sector", "defaut_par_secteur", ("secteur_activite",), ("nb_prets", "nb_defauts", "taux_defaut_pct", "montant_moyen",
     "exposition_millions_fcfa", "perte_potentielle_millions")),
    ("sql_by_product", "defaut_par_produit", ("type_produit",), ("nb_prets", "taux_defaut_pct", "montant_moyen",
     "duree_moyenne_mois", "taux_moyen")),
    ("sql_by_income", "defaut_par_revenu", ("tranche_revenu",), ("nb_prets", "taux_defaut_pct", "revenu_moyen", "montant_moyen",
     "perte_potentielle_millions")),
    ("sql_incidents", "impact_incidents", ("categorie",), ("nb_prets", "nb_defauts", "taux_defaut_pct", "montant_moyen")),
    ("sql_geo", "analyse_geographique", ("ville",), ("nb_clients", "encours_millions", "concentration_pct", "taux_defaut_pct")),
    ("sql_critical_segments", "segments_critiques", ("secteur_activite", "garantie"), ("nb_prets", "taux_defaut_pct",
     "exposition_millions")),
    ("sql_class_matrix", "matrice_cobac", ("categorie_cobac",), ("nb_credits", "encours_milliards", "part_pct", "taux_defaut_observe")),
    ("sql_top_segments", "top_segments_risque", ("secteur_activite", "type_produit"), ("nb_prets", "taux_defaut_pct",
     "perte_potentielle_millions")),
    ("sql_summary", "dashboard_synthetique", ("indicateur", "valeur"), ()),
)


def _entries(sql: str, report: str, texts, numbers) -> str:
    """A report as one row per number: report, the row's texts, column, value."""
    line = " || '|' || ".join(f"coalesce({c}, '')" for c in texts) or "''"
    pairs = ", ".join(f"{{'c': '{c}', 'v': {c}::DOUBLE}}" for c in numbers) or "{'c': '', 'v': NULL::DOUBLE}"
    return (f"SELECT '{report}' AS rapport, ligne, e.c AS colonne, e.v AS valeur FROM "
            f"(SELECT {line} AS ligne, unnest([{pairs}]) AS e FROM ({sql}))")
