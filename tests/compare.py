"""Results of Spark and DuckDB as comparable rows."""


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck_rows(con, sql):
    got = con.execute(sql)
    have = [d[0] for d in got.description]
    names = sorted(have)
    return names, sorted(tuple(plain(row[have.index(c)]) for c in names) for row in got.fetchall())
