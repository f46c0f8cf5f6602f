"""Row normalisation shared by the check tool and the tests."""

import datetime as dt
import decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0 if v else 0.0)
    if isinstance(v, decimal.Decimal):
        return f"decimal:{v}"
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [names[i] for i in order]
