"""Loan portfolio over the given star-schema tables: one loan per order line.

The tables hold no loans, so every loan column is an expression over their columns. The same definitions stand as
SQL text in ``checks/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.functions.expressions import lookup
from loanscope.functions.rules import class_by_arrears, debt_ratio, provision
from loanscope.operators.clean import CleanResult, clean
from loanscope.operators.derive import label_above_quantile, risk_score
from loanscope.session import configure, staged

# ---- fixed values: weights of the fixture's own products and sectors ---------------------------------------
PRODUCT_WEIGHTS = {
    "ECONOMY": 0.25, "LARGE": 0.10, "MEDIUM": 0.30, "PROMO": 0.20, "SMALL": 0.15, "STANDARD": 0.35,
}
SECTOR_WEIGHTS = {"AUTOMOBILE": 0.20, "BUILDING": 0.28, "FURNITURE": 0.15, "HOUSEHOLD": 0.30}
OTHER_SECTOR = 0.05
DURATIONS = (6, 12, 24, 36, 60, 84, 120, 180)

_memo: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, what: str, build):
    """Stage tables are built once per application and input folder, as a pipeline would between its steps."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _memo:
        _memo[key] = build()
    return _memo[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sector_weight(c: str) -> Column:
    return F.coalesce(lookup(c, SECTOR_WEIGHTS), F.lit(OTHER_SECTOR))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loans before the label: the five-table join.

    Each order line moves twice, by part and by order, with the columns it gives to its loan and no more. The hints keep this one plan
    at every size: tables that are broadcast while they are small and sorted with all columns once they are not would move more bytes a row.
    Neither sorts: what is built for a partition is its share of the parts or orders. AQE splits hot keys all the same.
    """
    line = table(spark, sf_dir, "lineitem").withColumn("h", (
        F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 1299709
        + F.col("l_linenumber").cast("bigint") * 15485863) % 10007)
    h = F.col("h")
    slot = F.col("l_quantity").cast("bigint") % 8
    duration = F.when(slot == 0, DURATIONS[0])
    for i, months in enumerate(DURATIONS[1:], 1):
        duration = duration.when(slot == i, months)
    line = line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "h",
        F.floor(
            F.col("l_extendedprice") * (F.lit(1) + (F.col("l_partkey") * 13) % 60) * F.when(h % 20 == 0, 4).otherwise(1)
        ).cast("bigint").alias("montant_credit_fcfa"),
        duration.alias("duree_mois"),
        ((F.lit(700) + (F.col("l_discount") * 8000).cast("bigint")).cast("double") / 100.0).alias("taux_interet"),
        F.when(h % 137 != 5, F.concat("l_returnflag", "l_linestatus")).alias("garantie"),
        "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    borrowers = (
        orders.join(customer.hint("shuffle_hash"), orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select("o_orderkey", "o_orderpriority", "c_custkey", "c_acctbal", "c_mktsegment", "n_name")
    )
    joined = (
        line.join(part.hint("shuffle_hash"), line.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey")
        .join(borrowers.hint("shuffle_hash"), line.l_orderkey == borrowers.o_orderkey)
    )
    incident_slot = (h * 37) % 100
    loans = joined.select(
        F.concat(F.lit("CLI"), F.lpad((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string"), 9, "0"))
        .alias("client_id"),
        (F.lit(15) + (F.col("c_custkey") * 7919) % 70).cast("int").alias("age"),
        F.col("n_name").alias("ville"),
        F.col("c_mktsegment").alias("secteur_activite"),
        F.col("o_orderpriority").alias("type_emploi"),
        F.when(h % 131 != 7, F.lit(1) + (h * 31) % 239).cast("int").alias("anciennete_client_mois"),
        F.when(h % 211 != 3, F.floor((F.col("c_acctbal") + 1200) * 120)).cast("bigint").alias("revenu_mensuel_fcfa"),
        F.col("p_type").alias("type_produit"),
        "montant_credit_fcfa",
        "duree_mois",
        "taux_interet",
        "garantie",
        F.when(incident_slot < 12, 1).when(incident_slot < 14, 2).otherwise(0).alias("nb_incidents_24m"),
        (F.col("l_linenumber") % 4).cast("int").alias("nb_credits_en_cours"),
        F.col("l_shipdate").cast("timestamp").alias("date_octroi"),
        "h",
    )
    ratio = debt_ratio()
    loans = loans.withColumn("ratio_endettement", F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(3.0))))
    noise = ((h * 53) % 2001 - 1000).cast("double") * F.lit(0.00008)
    return loans.withColumn("score_risque", risk_score(
        lookup("type_produit", PRODUCT_WEIGHTS), sector_weight("secteur_activite"),
        F.coalesce(F.col("ratio_endettement"), F.lit(0.0)), noise=noise))


def loans_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    # the last join has dealt the loans by order: no task reads one row group of the files ever after
    return once(spark, sf_dir, "base", lambda: staged(_base(spark, sf_dir), "loans_base"))


def loans_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base loans with label, arrears, class and provision; still one row per order line."""
    base = loans_base(spark, sf_dir)
    labelled = once(spark, sf_dir, "labelled", lambda: label_above_quantile(base, "score_risque", 0.78))
    h = F.col("h")
    return (
        labelled
        .withColumn("jours_retard", F.when(F.col("defaut") == 1, F.lit(30) + (h * 17) % 470).otherwise(0).cast("int"))
        .withColumn("classification_cobac", class_by_arrears("jours_retard"))
        .withColumn("provision_fcfa", provision("montant_credit_fcfa", "classification_cobac"))
    )


def loans_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw portfolio: 20 columns, with the injected duplicate rows."""
    labelled = loans_labelled(spark, sf_dir)
    copies = F.when(F.col("h") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return labelled.withColumn("copy", F.explode(copies)).drop("copy", "h", "score_risque")


def cleaned(spark: SparkSession, sf_dir: str) -> CleanResult:
    configure(spark)
    return once(spark, sf_dir, "clean",
                 lambda: clean(loans_raw(spark, sf_dir), product_risk=PRODUCT_WEIGHTS))


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).credits
