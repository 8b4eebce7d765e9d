"""A plain Python loop of the closure, used as the independent reference."""


def closure_loop(edges, seeds, max_rounds=None, stop="count"):
    """edges: list of (src, dest), already trimmed; seeds: list (duplicates count).

    Returns (final set, sizes per round incl. round 0, rounds, sets per round).
    """
    current = set(seeds)
    sizes = [len(seeds)]
    sets_ = [set(seeds)]
    last, cur, i = 0, len(seeds), 0
    while (max_rounds is None or i < max_rounds):
        if stop == "count" and last == cur:
            break
        if stop == "set" and i > 0 and sets_[-1] == sets_[-2]:
            break
        if stop == "set" and i == 0 and not seeds:
            break
        i += 1
        nxt = set()
        for s, d in edges:
            if (s is not None and s in current) or (d is not None and d in current):
                nxt.add(s)
                nxt.add(d)
        last, cur = cur, len(nxt)
        current = nxt
        sizes.append(cur)
        sets_.append(set(nxt))
    return current, sizes, i, sets_
