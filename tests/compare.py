"""Tables as sorted rows of text, to compare results of two engines."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if hasattr(value, "tolist"):
        value = value.tolist()
    return str(value)


def rows_of(frame):
    return sorted(tuple(shown(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def duck(sql, sf_dir=None, **tables):
    con = duckdb.connect()
    if sf_dir:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()
