"""A small model of the node in plain Python, the tests' second opinion."""

from __future__ import annotations


def gate(rows, seed=None):
    """(decision, expected, missing) for rows of (producer, detector, sequence number) in order of arrival."""
    high = dict(seed or {})
    out = []
    for producer, detector, n in rows:
        hw = high.get((producer, detector))
        if hw is None:
            out.append(("Accept", None, None))
        elif n <= hw:
            out.append(("Duplicate", None, None))
        elif n == hw + 1:
            out.append(("Advance", None, None))
        else:
            out.append(("Gap", hw + 1, n - hw - 1))
        high[producer, detector] = n if hw is None else max(hw, n)
    return out


def fold(group):
    loops = [r for r in group if r["rssi"] is not None]
    if loops:
        peak = group[0]
        for r in group[1:]:
            if (r["rssi"] if r["rssi"] is not None else -32768) >= (peak["rssi"] if peak["rssi"] is not None else -32768):
                peak = r
    else:
        peak = group[0]
        for r in group[1:]:
            if r["t"] < peak["t"]:
                peak = r
    span = max(r["t"] for r in group) - min(r["t"] for r in group)
    u = peak["u"]
    if span > 0:
        u = span if u is None else max(u, span)
    return {"point": group[0]["point"], "subject": group[0]["subject"], "at": peak["t"], "u": u, "ids": [r["id"] for r in group]}


def crossings(rows, window, flush=False):
    """(crossing, arrival of the row that closed it) in order; rows are dicts in order of arrival."""
    open_, out = {}, []
    for r in rows:
        if r["subject"] is None:
            out.append((fold([r]), r["arrival"]))
            continue
        key = r["point"], r["subject"]
        group = open_.get(key)
        if group is None:
            open_[key] = [r]
        elif max(r["t"] - group[0]["t"], 0) <= window:
            group.append(r)
        else:
            out.append((fold(group), r["arrival"]))
            open_[key] = [r]
    if flush:
        out += [(fold(g), None) for g in open_.values()]
    return out
