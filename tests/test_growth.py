"""Plans and passes whose cost must grow no faster than the tables."""

import re

from pyspark.sql import types as T

from checks import catalog
from checks import loans as L
from loanscope.operators import scoring as Z
from loanscope.sources import loans as IO


def test_loans_are_joined_by_one_plan_at_every_size(spark, sf_dir):
    """The order lines move twice, whatever the sizes of the tables; only the nations may be broadcast, and nothing is sorted."""
    plan = L._base(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ShuffledHashJoin", plan)) == 3
    assert len(re.findall(r"BroadcastHashJoin", plan)) == 1
    assert not re.search(r"SortMergeJoin|\bSort\b", plan)
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 6  # lines by part and by order, orders twice, customers, parts



def test_documents_are_read_once(spark, sf_dir):
    """What follows the reading of the documents starts at stored rows: no branch parses them again."""
    plan = catalog.serve_batch_payloads(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "to_json" not in plan


def test_each_model_reads_its_fold_alone(spark, sf_dir):
    credits = L.credits(spark, sf_dir).limit(300)
    models = Z.fit_folds(credits, Z.LOGISTIC, 2, Z.ModelSizes(logistic_iterations=2))
    scored = Z.predict_out_of_fold(credits, models)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and len(re.findall(r"PartitionFilters: \[isnotnull\(fold#\d+\), \(fold#\d+ = \d\)\]", plan)) == 2
    assert scored.count() == 300


def test_lines_are_accepted_without_a_list_per_line(spark, tmp_path):
    """Reading builds no list of bad columns, keeps the lines that hold their types and agrees with what is set aside."""
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.LongType()), T.StructField("c", T.DoubleType()),
                           T.StructField("d", T.StringType())])
    good = [("5", 5), (" 7 ", 7), ("+6", 6), ("007", 7), ("8.", 8), ("9.00", 9), ("-3", -3), ("", None), ("NaN", None), ("2147483647", 2147483647)]
    bad = ["7.9", "1e3", "x", "2147483648", "--1", "5L", "\u00a05"]
    lines = [f"{text},{text},1.5,d{i}" for i, text in enumerate([g for g, _ in good] + bad)] + ["1,2", "1,2,oops,z", "1,2,NaN,w"]
    (tmp_path / "t.csv").write_text("\n".join(["a,b,c,d", *lines]) + "\n", encoding="utf-8")
    read = IO.read_csv(spark, str(tmp_path), schema)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "array(" not in plan and "lambda" not in plan
    got = {r.d: (r.a, r.b, r.c) for r in read.collect()}
    assert got == {f"d{i}": (v, v, 1.5) for i, (_, v) in enumerate(good)} | {"w": (1, 2, None)}
    aside = sorted((r.line, r.bad_columns) for r in IO.rejected_csv(spark, str(tmp_path), schema).collect())
    wrong = {f"{text},{text},1.5,d{i}": ["a"] if text == "2147483648" else ["a", "b"] for i, text in enumerate(bad, len(good))}
    assert aside == sorted((wrong | {"1,2": ["a", "b", "c", "d"], "1,2,oops,z": ["c"]}).items())
