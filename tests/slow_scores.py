"""Scores of one pair of strings by their definitions, for comparison."""


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else (1 - (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b))) * 100.0


def quick_ratio(a, b):
    return ratio(a, b) if a and b else 0.0


def partial(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    best = 0.0
    for s, t in {(short, long), (long, short)} if len(a) == len(b) else {(short, long)}:
        for w in {t[max(0, k) : k + len(s)] for k in range(1 - len(s), len(t))}:
            best = max(best, ratio(s, w))
    return best


def token_sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if not x or not y:
        return 0.0
    if both and (x <= y or y <= x):
        return 100.0
    dx, dy = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    whole = [(both + " " + d).strip() for d in (dx, dy)]
    score = 100.0 - 100.0 * (len(dx) + len(dy) - 2 * lcs(dx, dy)) / (len(whole[0]) + len(whole[1]))
    return max(score, *[100.0 - 100.0 * (len(w) - len(both)) / (len(both) + len(w)) for w in whole]) if both else score


def weighted_ratio(a, b):
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.9 if spread <= 8 else 0.6
    if set(a.split()) & set(b.split()):
        words = 100.0
    else:
        words = max(partial(*[" ".join(sorted(v.split())) for v in (a, b)]), partial(*[" ".join(sorted(set(v.split()))) for v in (a, b)]))
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * words)


SCORERS = {"ratio": ratio, "quick_ratio": quick_ratio, "partial": partial, "token_sort": token_sort, "token_set": token_set, "weighted_ratio": weighted_ratio}
