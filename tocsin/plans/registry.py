"""Named queries and the SQL that states the same result independently."""
QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add
