"""Compare registered queries with their check SQL: ``python tests/check_queries.py sf0.01 [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return normal(float(value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when both sides agree, else what differs."""
    spark_names, spark_rows = rows_of(df.columns, df.collect())
    got = con.execute(sql)
    check_names, check_rows = rows_of([d[0] for d in got.description], got.fetchall())
    if spark_names != check_names:
        return f"columns {spark_names} / {check_names}"
    if spark_rows != check_rows:
        return (
            f"rows {sum(spark_rows.values())} / {sum(check_rows.values())}; only query "
            f"{list((spark_rows - check_rows).items())[:3]}; only check {list((check_rows - spark_rows).items())[:3]}"
        )
    return None


def main(argv):
    from signaloom.plans import registry
    from signaloom.session import build_session

    scale, wanted = (argv or ["sf0.01"])[0], argv[1:]
    sf_dir = f"/root/testdata/{scale}"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
                                "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"}
    )
    con = connect(sf_dir)
    bad = 0
    for name, query in registry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        begun = time.time()
        try:
            df, sql = query(spark, sf_dir), registry.oracle_sql().get(name)
            problem = f"unchecked, {df.count()} rows" if sql is None else compare(df, con, sql)
            failed = problem is not None and sql is not None
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            failed, problem = True, "".join(traceback.format_exception_only(error))[:900]
        bad += failed
        print(f"{'BAD ' if failed else 'ok  '} {name} {time.time() - begun:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
