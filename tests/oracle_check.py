"""Compare registered queries with their reference SQL, values exactly.

    python tests/oracle_check.py [folder] [query ...]
"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(folder):
    import duckdb

    base = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return base


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def differences(frame, sql, base):
    """None when schema and rows agree, else a short description."""
    result = base.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    order = sorted(names)
    if sorted(frame.columns) != order:
        return f"columns {sorted(frame.columns)} vs {order}"
    for name, kind in frame.dtypes:
        if TYPES.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} vs {kinds[name]}"
    at = [names.index(n) for n in order]
    theirs = Counter(tuple(_plain(row[i]) for i in at) for row in result.fetchall())
    ours = Counter(tuple(_plain(v) for v in row) for row in frame.select(*order).collect())
    if ours == theirs:
        return None
    extra, missing = ours - theirs, theirs - ours
    show = lambda c: [str(r)[:300] for r in list(c)[:2]]
    return (
        f"rows {sum(ours.values())} vs {sum(theirs.values())}; only here {sum(extra.values())} "
        f"{show(extra)}; only there {sum(missing.values())} {show(missing)}"
    )


if __name__ == "__main__":
    import __spark_entry__ as contract
    from kohorta.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, base = local_session(), connect(folder)
    sqls, bad = contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            found = differences(frame, sqls[name], base) if name in sqls else None
            note = "" if name in sqls else f" (rows only: {frame.count()})"
        except Exception as error:  # noqa: BLE001
            found, note = f"{type(error).__name__}: {str(error)[:700]}", ""
        bad += found is not None
        print(f"{'FAIL' if found else 'ok':4} {time.time() - start:6.1f}s {name}{note} {found or ''}", flush=True)
    print("failures:", bad)
