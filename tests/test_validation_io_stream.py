import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanscope.operators import scoring as Z
from loanscope.operators import validate as V
from loanscope.schemas import APPLICATION_SCHEMA, RAW_SCHEMA
from loanscope.sources import loans as IO
from loanscope.sources.loans import CORRUPT
from loanscope.streaming import scoring as ST

GOOD = {
    "age": 35, "ville": "NATION_1", "secteur_activite": "BUILDING", "type_emploi": "2-HIGH",
    "anciennete_client_mois": 48, "revenu_mensuel_fcfa": 600_000, "type_produit": "PROMO",
    "montant_credit_fcfa": 2_000_000, "duree_mois": 36, "taux_interet": 11.5, "garantie": "AF",
    "nb_incidents_24m": 0, "nb_credits_en_cours": 1,
}
BROKEN = [
    ({"age": 17}, ["age:ge_18"]), ({"age": 101}, ["age:le_100"]), ({"age": None}, ["age:required"]),
    ({"anciennete_client_mois": -1}, ["anciennete_client_mois:ge_0"]),
    ({"revenu_mensuel_fcfa": 0}, ["revenu_mensuel_fcfa:gt_0"]),
    ({"montant_credit_fcfa": 0}, ["montant_credit_fcfa:gt_0"]),
    ({"duree_mois": 0}, ["duree_mois:gt_0"]), ({"taux_interet": 0.0}, ["taux_interet:gt_0"]),
    ({"nb_incidents_24m": 11}, ["nb_incidents_24m:le_10"]), ({"nb_incidents_24m": -1}, ["nb_incidents_24m:ge_0"]),
    ({"nb_credits_en_cours": 21}, ["nb_credits_en_cours:le_20"]),
    ({"nb_credits_en_cours": -1}, ["nb_credits_en_cours:ge_0"]),
    ({"garantie": None, "age": 5}, ["garantie:required", "age:ge_18"]),
]
KEPT = [{}, {"age": 18}, {"age": 100}, {"anciennete_client_mois": 0}, {"nb_incidents_24m": 10},
        {"nb_credits_en_cours": 20}, {"nb_incidents_24m": None, "nb_credits_en_cours": None}]


def applications(spark, changes):
    return spark.createDataFrame(
        [tuple({**GOOD, **c}[f.name] for f in APPLICATION_SCHEMA.fields) for c in changes], APPLICATION_SCHEMA)


@pytest.mark.parametrize("change,expected", BROKEN)
def test_each_rule(spark, change, expected):
    got = V.quarantine(applications(spark, [change])).first()
    assert got.violations == expected


def test_valid_rows_and_defaults(spark):
    out = V.valid(applications(spark, KEPT + [c for c, _ in BROKEN]))
    assert out.count() == len(KEPT)
    assert out.filter("nb_incidents_24m is null or nb_credits_en_cours is null").count() == 0
    counts = {r.regle: r.nb for r in V.rule_counts(applications(spark, [c for c, _ in BROKEN])).collect()}
    assert counts["age:ge_18"] == 2 and sum(counts.values()) == len(BROKEN) + 1


def test_batch_sizes(spark):
    df = spark.range(205).select(F.when(F.col("id") < 101, "large").when(F.col("id") < 201, "full").otherwise("small")
                                 .alias("lot"))
    got = {r.lot: (r.nb_clients, r.acceptee) for r in V.batch_verdicts(df, ["lot"]).collect()}
    assert got == {"large": (101, False), "full": (100, True), "small": (4, True)}


def test_csv_round_trip(spark, raw, tmp_path):
    path = str(tmp_path / "new" / "raw")
    IO.write_csv(raw, path)
    back = IO.read_raw(spark, path)
    assert back.schema == RAW_SCHEMA
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0


def test_csv_with_whole_numbers_spelled_as_decimals_and_nan(spark, tmp_path):
    header = ",".join(f.name for f in RAW_SCHEMA.fields)
    line = ("CLI000001,30,Oyem,BTP,Retraité,12.0,600000.0,Crédit auto,2000000.0,36,NaN,Aucune,0,1,2022-01-01 03:00:00,"
            "0.093,0,0,Saine,0.0")
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text(f"{header}\n{line}\n", encoding="utf-8")
    r = IO.read_raw(spark, str(folder)).first()
    assert (r.revenu_mensuel_fcfa, r.anciennete_client_mois, r.taux_interet, r.type_emploi) == (
        600000, 12, None, "Retraité")
    assert r.date_octroi.hour == 3


def test_parquet_round_trip(spark, credits, tmp_path):
    path = str(tmp_path / "clean")
    IO.write_parquet(credits, path)
    assert IO.read_parquet(spark, path).count() == credits.count()
    IO.write_csv(credits, str(tmp_path / "clean_csv"))
    assert IO.read_clean(spark, str(tmp_path / "clean_csv")).exceptAll(credits).count() == 0


def test_streaming_scores_equal_batch_scores(spark, credits, tmp_path):
    model = Z.fit_model(credits, Z.FOREST, Z.fit_encoders(credits),
                        Z.ModelSizes(forest_trees=3, forest_depth=3))
    incoming, out = str(tmp_path / "in"), str(tmp_path)

    def run():
        queries = ST.start_scoring(
            ST.read_applications(spark, incoming, max_files=1), model, f"{out}/scored", f"{out}/rejected",
            f"{out}/checkpoints", available_now=True)
        for q in queries:
            q.awaitTermination()

    first = applications(spark, KEPT + [c for c, _ in BROKEN])
    first.coalesce(2).write.mode("append").json(incoming)
    run()
    second = applications(spark, [{"age": 50}, {"age": 3}])
    second.coalesce(1).write.mode("append").json(incoming)
    run()  # restarted: only the new file is read
    from loanscope.plans.service import score_applications
    expected = score_applications(first.unionByName(second), model)
    got = spark.read.parquet(f"{out}/scored")
    cols = expected.columns
    assert got.select(cols).exceptAll(expected).count() == 0
    assert got.count() == expected.count() == len(KEPT) + 1
    assert spark.read.parquet(f"{out}/rejected").count() == len(BROKEN) + 1


def test_csv_loses_nothing(spark, tmp_path):
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("k", T.IntegerType()),
                           T.StructField("x", T.DoubleType()), T.StructField("t", T.TimestampType()), T.StructField("s", T.StringType())])
    lines = ["9007199254740993,7,0.1,2022-01-01 03:00:00.123456,a", "9007199254740993.0,7.00,1e3,2022-01-01,b", "1,7.9,1,2022-01-01,c",
             "1,2,bad,2022-01-01,d", "1,2,3,yesterday,e", "99999999999999999999,2,3,2022-01-01,f", "1,2", ",NaN,,,", "1,3000000000,1,2022-01-01,g"]
    folder = tmp_path / "exact"
    folder.mkdir()
    (folder / "a.csv").write_text("n,k,x,t,s\n" + "\n".join(lines) + "\n")
    good = {r.s: r for r in IO.read_csv(spark, str(folder), schema).collect()}
    assert set(good) == {"a", "b", None}
    assert good["a"].n == good["b"].n == 9007199254740993 and good["a"].t.microsecond == 123456 and good["b"].x == 1000.0
    rejected = {r.line: r.bad_columns for r in IO.rejected_csv(spark, str(folder), schema).collect()}
    assert {v[0] for k, v in rejected.items() if k != "1,2"} == {"k", "x", "t", "n"} and len(rejected) == 6
    assert len(rejected["1,2"]) == 5
    IO.write_csv(IO.read_csv(spark, str(folder), schema), str(tmp_path / "again"))
    assert {tuple(r) for r in IO.read_csv(spark, str(tmp_path / "again"), schema).collect()} == {tuple(r) for r in good.values()}


def test_unreadable_stream_lines_are_kept(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text('{"ville": "A", "age": 40}\n{"ville": "B", "age": \n')
    query = ST.read_applications(spark, str(folder)).writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.ville: r[CORRUPT] for r in spark.table("lines").collect()} == {"A": None, None: '{"ville": "B", "age": '}


def test_shared_folder_must_be_reachable():
    from loanscope.session import check_reachable
    check_reachable("file:/tmp/x", "local[8]")
    check_reachable("hdfs://name/x", "spark://host:7077")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            check_reachable("file:/tmp/x", master)
