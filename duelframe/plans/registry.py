"""All registered queries with their SQL twins."""

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r(expr, n=6):
    """SQL: rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {n}) + 0.0)"
