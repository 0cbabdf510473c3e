"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    from oracles import core_sql

    out = dict(core_sql.ORACLES)
    for name in ("terms_sql", "layout_sql", "stream_sql"):
        module = __import__(f"oracles.{name}", fromlist=["ORACLES"])
        out.update(module.ORACLES)
    return out
