"""An independent evaluator of specs in plain Python, for one observation at a time."""

from __future__ import annotations


def conflict_free(events, key, ignored=("ingested_at",)):
    """First delivery of each identity; raises on different payloads."""
    kept = {}
    for e in events:
        old = kept.setdefault(e[key], e)
        if {k: v for k, v in old.items() if k not in ignored} != {k: v for k, v in e.items() if k not in ignored}:
            raise ValueError(e[key])
    return list(kept.values())


def holds(text, row):
    return text is None or bool(eval(text, {"__builtins__": {}}, dict(row)))  # noqa: S307  test expressions only


def features(events, spec, contract, entity, t):
    """Outputs of a spec for the entity (a dict) at t."""
    rows = [e for e in conflict_free(events, contract.identity) if all(e[k] == v for k, v in entity.items()) and t - spec.window.size < e[contract.time] <= t]
    out = {}
    for a in spec.aggregations:
        hit = [e for e in rows if holds(a.filter, e)]
        values = [e[a.column] for e in hit] if a.column else []
        known = [v for v in values if v is not None]
        if a.op == "count":
            out[a.name] = len(hit)
        elif a.op == "sum":
            out[a.name] = sum(known)
        elif a.op == "avg":
            out[a.name] = sum(known) / len(known) if known else None
        elif a.op in ("min", "max"):
            out[a.name] = ({"min": min, "max": max}[a.op])(known) if known else None
        elif a.op == "approx_distinct":
            out[a.name] = len(set(values))
        else:
            hit.sort(key=lambda e: (e[contract.time], str(e[contract.identity])))
            out[a.name] = [e[a.column] for e in hit[-a.k :]]
    for name, text in spec.derived.items():
        try:
            out[name] = eval(text, {"__builtins__": {}}, dict(out))  # noqa: S307
        except TypeError:
            out[name] = None
    return out


def published(versions, entity, t, ttl):
    """(value, status) in force for an entity at t; versions are (entity, published at, rank, value)."""
    best = max(((at, rank, value) for e, at, rank, value in versions if e == entity and at <= t), default=None)
    if best is None:
        return None, "not_published"
    return (None, "expired") if t >= best[0] + ttl else (best[2], "present")
