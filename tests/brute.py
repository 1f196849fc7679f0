"""Plain, row-at-a-time versions of the queries, written without the operators, to compare with on small tables."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from datetime import datetime


def order(versions):
    """version ids in release order"""
    def at(v):
        return datetime.fromisoformat((v["build_time"] or v["imported_at"]).replace("Z", "+00:00"))

    return [v["version_id"] for v in sorted(versions, key=lambda v: (at(v), v["version_id"]))]


def p1(skills):
    num = lambda s: int(s.strip()) if re.fullmatch(r"\s*[+-]?\d+\s*", s or "") else None
    ids = {num(s["id"]) for s in skills} - {None}
    up = defaultdict(set)
    for s in skills:
        for r in dict(s["req"] or {}):
            if num(s["id"]) is not None and num(r) in ids:
                up[num(s["id"])].add(num(r))
    out = set()
    for i in up:
        seen, at = [], i
        while at not in seen:
            seen.append(at)
            if at not in up:
                break
            at = min(up[at])
        if at in up:
            ring = seen[seen.index(at):]
            out.add((i, min(ring), -1))
        else:
            out.add((i, at, len(seen) - 1))
    return out


def p2(levels, catalog):
    from decimal import Decimal

    fold = lambda s: re.sub(r"[^a-z0-9]", "", (s or "").lower())
    types = {fold(c["stat_name"]): (c["stat_name"], c["value_type"]) for c in catalog}

    def reads(v, t):
        v = v.strip()
        if t == "string":
            return v
        if t == "boolean":
            return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(v.lower())
        if t == "double":
            v = v.replace(",", ".")
            return float(v) + 0.0 if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) else None
        v = re.sub(r",(?=\d{3}(?!\d))", "", v)
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
            return None
        d = Decimal(v)
        return int(d) if d == int(d) else None

    cells = defaultdict(list)
    for r in levels:
        if fold(r["stat_name"]) in types and (r["stat_value"] or "").strip():
            name, t = types[fold(r["stat_name"])]
            cells[int(r["skill_id"]), r["skill_level"], name].append(reads(r["stat_value"], t))
    return {k for k, v in cells.items() if None in v or len(set(v)) > 1}


def p3(records, extractions, versions):
    rank = {v: i for i, v in enumerate(order(versions))}
    done = defaultdict(set)
    for e in extractions:
        done[e["extractor"]].add(e["version_id"])
    state = defaultdict(dict)
    for r in sorted(records, key=lambda r: r["loaded_at"]):
        key = "/".join(p for p in re.split(r"[/\\]", r["key"]) if p)
        state[r["source"], r["version_id"]][r["kind"], key] = r["hash"].strip().lower()
    out = set()
    for s, vs in done.items():
        vs = sorted(vs, key=rank.get)
        for a, b in zip(vs, vs[1:]):
            old, new = state[s, a], state[s, b]
            out |= {(b, *k, "added") for k in new.keys() - old.keys()}
            out |= {(b, *k, "removed") for k in old.keys() - new.keys()}
            out |= {(b, *k, "modified") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def p4(events, versions):
    rank = order(versions)
    ids = {v["label"].strip().lower(): v["version_id"] for v in versions}
    last = {}
    for e in sorted(events, key=lambda e: (e["received_at"], e["event_id"])):
        v = ids.get((e["version"] or "").strip().lower())
        if v is not None:
            last[e["kind"], e["key"], v] = e
    by = defaultdict(dict)
    for (kind, key, v), e in last.items():
        by[kind, key][v] = e
    out = set()
    for (kind, key), seen in by.items():
        held, since = None, None
        for v in rank:
            if v not in seen:
                continue
            e = seen[v]
            gone = (e["status"] or "").strip().lower() == "removed"
            now = None if gone else json.dumps(json.loads(e["data"]), sort_keys=True)
            if now != held:
                if held is not None:
                    out.add((kind, key, since, v))
                held, since = now, v
        if held is not None:
            out.add((kind, key, since, 0))
    return out


def p5(rows, versions):
    rank = {v: i for i, v in enumerate(order(versions))}

    def flat(o, p=""):
        for k, v in o.items():
            if isinstance(v, dict):
                yield from flat(v, f"{p}{k}/")
            else:
                yield p + k, v

    files = defaultdict(lambda: defaultdict(dict))
    for r in sorted(rows, key=lambda r: r["line_no"]):
        try:
            o = json.loads(r["payload"])
        except (TypeError, ValueError):
            continue
        for p, v in flat(o):
            files[r["feed"], r["version_id"]][p][o["id"]] = v
    feeds = defaultdict(list)
    for f, v in files:
        feeds[f].append(v)
    out = set()
    for f, vs in feeds.items():
        vs.sort(key=rank.get)
        for a, b in zip(vs, vs[1:]):
            old, new = files[f, a], files[f, b]
            went, came = set(old) - set(new), set(new) - set(old)
            pairs = []
            for p in went:
                for q in came:
                    both = [i for i in old[p].keys() & new[q].keys() if old[p][i] is not None and new[q][i] is not None]
                    if both and all(json.dumps(old[p][i]) == json.dumps(new[q][i]) for i in both):
                        pairs.append((-len(both), p, q))
            used = set()
            for _, p, q in sorted(pairs):
                if p in went and q in came:
                    went.discard(p), came.discard(q)
                    used.add((p, q))
            out |= {(f, b, "renamed", p, q) for p, q in used}
            out |= {(f, b, "removed", p, "") for p in went} | {(f, b, "added", p, "") for p in came}
            for p in old.keys() & new.keys():
                ta, tb = ({type(x) for x in side[p].values() if x is not None} for side in (old, new))
                if ta and tb and ta != tb:
                    out.add((f, b, "retyped", p, ""))
    return out


def p6(rows):
    out = set()

    def held(x):
        if isinstance(x, str):
            try:
                y = json.loads(x)
            except ValueError:
                return x
            y = held(y) if isinstance(y, str) else y
            return y if isinstance(y, (dict, list)) else x
        return x

    def walk(r, x, path, around):
        x = held(x)
        if isinstance(x, dict):
            if path:
                out.add((r["kind"], r["key"], "/".join(path), "/".join(around)))
            for k, v in x.items():
                walk(r, v, [*path, k], path)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(r, v, [*path, str(i)], around)

    for r in rows:
        try:
            walk(r, json.loads(r["data"]), [], [])
        except (TypeError, ValueError):
            pass
    return out
