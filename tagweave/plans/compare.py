"""Spark result vs DuckDB oracle: row count, column names and an
order-insensitive hash of the values (columns sorted by name)."""

from __future__ import annotations

import hashlib
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))) + "}"
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return str(v)


def digest(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for ln in lines:
        h.update(ln.encode("utf-8", "surrogatepass"))
        h.update(b"\n")
    return h.hexdigest()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, key: str, qfn, sql: str | None, sf_dir: str, con=None) -> dict:
    df = qfn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    out = {"key": key, "rows": len(rows), "cols": cols}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    out["oracle_rows"] = len(orows)
    out["schema_ok"] = sorted(cols) == sorted(ocols)
    out["hash_ok"] = out["schema_ok"] and digest(cols, rows) == digest(ocols, orows)
    out["status"] = "SAME" if (out["hash_ok"] and len(rows) == len(orows)) else "DIFF"
    if out["status"] == "DIFF":
        out["oracle_cols"] = ocols
        if out["schema_ok"]:
            a = set("\x1f".join(_norm(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rows)
            b = set("\x1f".join(_norm(r[i]) for i in sorted(range(len(ocols)), key=lambda i: ocols[i])) for r in orows)
            out["only_spark"] = sorted(a - b)[:3]
            out["only_oracle"] = sorted(b - a)[:3]
    return out
