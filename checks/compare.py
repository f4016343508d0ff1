"""Run the registered queries next to their SQL counterparts and compare counts, columns, types and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


_KIND = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp",
    "BOOLEAN": "boolean",
}


def compare(spark: SparkSession, sf_dir: str, query, sql: str, con=None) -> list[str]:
    """Differences, empty when both sides agree."""
    con = con or connect(sf_dir)
    df = query(spark, sf_dir)
    ours = _rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _KIND.get(str(d[1]), str(d[1])) for d in result.description}
    theirs = _rows(names, result.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} / {sorted(names)}")
        return out
    types = dict(df.dtypes)
    out += [f"type of {c}: {types[c]} / {kinds[c]}" for c in names if types[c] != kinds[c]]
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} / {len(theirs)}")
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        out.append(f"{len(different)} rows differ, first {different[0][0]} / {different[0][1]}")
    return out


def main(sf_dir: str, only: list[str]) -> int:
    from checks import catalog, oracle
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), oracle.statements()
    failed = 0
    for name, query in catalog.registered().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                problems = compare(spark, sf_dir, query, sqls[name], con)
            else:
                df = query(spark, sf_dir)
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as e:  # noqa: BLE001  report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok" if name in sqls else "rows")
        print(f"{mark:5}{name:32}{time.time() - start:6.2f}s  {'; '.join(problems)}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
