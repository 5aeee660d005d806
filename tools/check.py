"""Run registered queries and their SQL side by side: python tools/check.py [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, order):
    def value(v):
        if v is None:
            return "~null"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return str(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def main() -> int:
    folder = "/root/testdata/sf0.01"
    names = sys.argv[1:]
    if names and names[0].startswith("/"):
        folder = names.pop(0)
    from tallyweave.catalog import load
    from tallyweave.session import build_session

    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    chosen = [n for n in queries if not names or any(n == x or n.startswith(x) for x in names)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            columns = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            result = con.execute(oracle[name])
            sql_columns = [d[0] for d in result.description]
            types = {d[0]: str(d[1]) for d in result.description}
            expected = result.fetchall()
            sql_took = time.time() - start
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: SQL {str(error)[:1500]}", flush=True)
            continue
        if sorted(columns) != sorted(sql_columns):
            bad += 1
            print(f"FAIL {name}: columns {sorted(set(columns) ^ set(sql_columns))}", flush=True)
            continue
        ordered = sorted(columns)
        left = canonical(rows, [columns.index(c) for c in ordered])
        right = canonical(expected, [sql_columns.index(c) for c in ordered])
        if left != right:
            bad += 1
            a, b = set(left), set(right)
            print(f"FAIL {name}: spark {len(left)} sql {len(right)}\n  {ordered}", flush=True)
            for row in sorted(a - b)[:3]:
                print("  spark", row)
            for row in sorted(b - a)[:3]:
                print("  sql  ", row)
            continue
        wide = [c for c, t in types.items() if "HUGEINT" in t or t.startswith("DECIMAL")]
        kinds = dict(df.dtypes)
        note = f" WIDE {wide}" if wide else ""
        odd = [c for c in columns if (kinds[c] == "int") != (types[c] == "INTEGER") or (kinds[c] == "double") != (types[c] == "DOUBLE")]
        if odd:
            note += f" TYPES {[(c, kinds[c], types[c]) for c in odd]}"
        print(f"ok   {name}: {len(rows)} rows {took:.1f}s sql {sql_took:.1f}s{note}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
