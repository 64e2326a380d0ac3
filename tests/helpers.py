import datetime as dt
import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
    return [cols[i] for i in order], sorted(out, key=key)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
