"""Compare every registered query with its SQL on the same tables.

Run as a script: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return None if value is None else str(value)


def family(kind: str) -> str:
    kind = kind.lower()
    for prefix, name in (("bigint", "long"), ("hugeint", "huge"), ("int", "int"), ("double", "double"), ("float", "float"), ("decimal", "decimal"), ("varchar", "string"), ("bool", "boolean"), ("date", "date"), ("timestamp", "timestamp")):
        if kind.startswith(prefix):
            return name
    return kind


def compare(spark, con, sf_dir: str, fn, sql: str) -> list[str]:
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(str(plain(r[c])) for c in names) for r in df.collect())
    relation = con.execute(sql)
    their_names = [d[0] for d in relation.description]
    kinds = {d[0]: family(str(d[1])) for d in relation.description}
    rows = relation.fetchall()
    problems = []
    if sorted(their_names) != names:
        return [f"columns differ: {names} / {sorted(their_names)}"]
    spark_kinds = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    mismatched = {c: (spark_kinds[c], kinds[c]) for c in names if spark_kinds[c] != kinds[c]}
    if mismatched:
        problems.append(f"types differ: {mismatched}")
    index = [their_names.index(c) for c in names]
    theirs = sorted(tuple(str(plain(row[i])) for i in index) for row in rows)
    if len(ours) != len(theirs):
        problems.append(f"row counts differ: {len(ours)} / {len(theirs)}")
    if ours != theirs:
        wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
        problems.append(f"{len(wrong)} rows differ, first: {[tuple(str(x)[:60] for x in t) for t in wrong[0]] if wrong else ''}")
    if not ours:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from panelweave.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="checkpoint-"), spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                problems = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                problems = [] if fn(spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(problems)
        note = "" if name in sqls else " (rows only)"
        print(f"{'FAIL' if problems else 'ok  '} {name}{note} {time.time() - start:.1f}s {' | '.join(problems)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
