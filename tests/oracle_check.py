"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, rows (spark/duckdb), match flag.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) is None \
            else pd.Timestamp(v).tz_convert("UTC").tz_localize(None).isoformat()
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return str(list(v))
    return v


def canon(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    rows.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return cols, rows


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in (names or qs):
        t0 = time.time()
        try:
            s = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = ("spark-error", str(e)[:300])
            print(name, "SPARK ERROR", str(e)[:500]) if verbose else None
            continue
        ts = time.time() - t0
        if name not in oracle:
            out[name] = ("rows-only", len(s))
            print(f"{name:32s} rows={len(s):7d} (no oracle) {ts:.1f}s") if verbose else None
            continue
        try:
            o = con.execute(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            out[name] = ("sql-error", str(e)[:300])
            print(name, "SQL ERROR", str(e)[:500]) if verbose else None
            continue
        sc, sr = canon(s)
        oc, orr = canon(o)
        ok = sc == oc and sr == orr
        out[name] = ("ok" if ok else "MISMATCH", len(s), len(o))
        if verbose:
            print(f"{name:32s} rows={len(s):7d}/{len(o):7d} {'OK' if ok else 'MISMATCH'} {ts:.1f}s")
            if not ok:
                if sc != oc:
                    print("   cols spark-only", sorted(set(sc) - set(oc)), "sql-only", sorted(set(oc) - set(sc)))
                else:
                    diff = [(a, b) for a, b in zip(sr, orr) if a != b]
                    from collections import Counter
                    cnt = Counter(c for a, b in diff for c, x, y in zip(sc, a, b) if x != y)
                    print("   differing rows", len(diff), "by column", dict(cnt))
                    for a, b in diff[:2]:
                        for c, x, y in zip(sc, a, b):
                            if x != y:
                                print(f"   {c}: spark={x!r} sql={y!r}")
                        print("   --")
    return out


if __name__ == "__main__":
    from callrisk.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "rows-only")]
    print("BAD:", bad)
