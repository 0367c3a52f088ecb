"""A small plain-Python model of prefix-tree mining, written for the tests
"""

from __future__ import annotations

import hashlib
import re


def mask(line: str, masks) -> str:
    if not masks:
        return line
    return re.sub("|".join(f"(?:{m})" for m in masks), "<*>", line)


def mine(lines, masks, depth=4, st=0.5, max_child=100):
    """Returns {line index: template} processing lines in order."""
    root = {}
    clusters = []  # [tokens(list)]
    owner = {}
    levels = depth - 1

    def digit(t):
        return any(c.isdigit() for c in t)

    for i, line in enumerate(lines):
        toks = mask(line, masks).split()
        n = len(toks)
        found = None
        if n >= depth and n in root:
            node = root[n]
            ok = True
            for t in toks[:levels]:
                if t in node["kids"]:
                    node = node["kids"][t]
                elif "<*>" in node["kids"]:
                    node = node["kids"]["<*>"]
                else:
                    ok = False
                    break
            if ok:
                best, best_key = None, None
                for c in node["leaf"]:
                    tpl = clusters[c]
                    same = sum(1 for a, b in zip(tpl, toks) if a != "<*>" and a == b)
                    wild = sum(1 for a in tpl if a == "<*>")
                    key = (same, wild)
                    if best_key is None or key > best_key:
                        best, best_key = c, key
                if best is not None and best_key[0] / n >= st:
                    found = best
        if found is not None:
            clusters[found] = [a if a == b else "<*>" for a, b in zip(clusters[found], toks)]
            owner[i] = found
            continue
        clusters.append(list(toks))
        cid = len(clusters) - 1
        owner[i] = cid
        if n < depth:
            continue
        node = root.setdefault(n, {"kids": {}, "leaf": []})
        for t in toks[:levels]:
            kids = node["kids"]
            if t in kids:
                node = kids[t]
                continue
            if digit(t):
                node = kids.setdefault("<*>", {"kids": {}, "leaf": []})
            elif "<*>" in kids:
                if len(kids) < max_child:
                    node = kids.setdefault(t, {"kids": {}, "leaf": []})
                else:
                    node = kids["<*>"]
            elif len(kids) + 1 < max_child:
                node = kids.setdefault(t, {"kids": {}, "leaf": []})
            else:
                node = kids.setdefault("<*>", {"kids": {}, "leaf": []})
        node["leaf"].append(cid)
    return {i: " ".join(clusters[c]) for i, c in owner.items()}


def event_id(template: str) -> str:
    return hashlib.md5(template.encode()).hexdigest()[:8]
