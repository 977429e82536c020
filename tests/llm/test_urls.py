import math
import re
from collections import Counter

import pytest

from ledgerloom.llm import urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
TEXT = "<p>The green house and the red car shop <b>the</b> house</p><script>var x='nothing'</script>"
URLS = [
    "http://WWW.Example.NET/en/1", "https://a.example.net/de/", "https://example.net/EN/", "https://b.example.com/de/x?y#z", "https://badexample.com/de/", "http://x.org/fr/?q=/en/",
    "https://greenhouse.com/en/redcar/3", "https://casino-win.com/en/1", "https://casino-win.com/en/1", "https://win.com/en/", "http://host?x=/net/", "http://host#frag", "ftp://a.net",
    "no scheme", "", None, "http:///only/path", "x://a://b.net/p", "http://x.net.evil.com/", "http://shop-house.com/", "https://pillsshop.com/",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, TEXT, "clash", "clash") for i, u in rows], "page_id long, url string, html string, host string, verdict string").repartition(3)


def brute(rows):
    host_n, parsed = Counter(), {}
    for i, u in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        parsed[i] = host, path
        host_n[host] += 1
    lexicon = Counter(w for _ in rows for w in re.findall(r"[^\W\d_]+", re.sub(r"(?is)<script.*?</script>|<[^>]*>", " ", TEXT).lower()))
    for host, n in host_n.items():
        for label in host.split("."):
            if "-" in label:
                lexicon.update({w: n for w in re.findall(r"[^\W\d_]+", label) if len(w) <= 20} if len(set(re.findall(r"[^\W\d_]+", label))) else {})
    total = sum(lexicon.values())

    def best(name):
        options = [[]] if not name else [[name[:k], *rest] for k in range(1, len(name) + 1) for rest in (best(name[k:]),)]
        cost = lambda ws: sum(math.log(total + 1) - math.log(lexicon[w]) if lexicon[w] else math.log(total + 1) + len(w) * math.log(10) for w in ws)
        return min(options, key=lambda ws: (round(cost(ws), 9), len(ws)))

    words = {h: [w for name in re.findall(r"[^\W\d_]+", h) for w in best(name)] for h in host_n}
    tokens = {i: words[h] + re.findall(r"[^\W\d_]+", p.lower()) for i, (h, p) in parsed.items()}
    bad = {i: bool(set(words[h]) & set(urls.BAD_WORDS)) for i, (h, _) in parsed.items()}
    counts = {b: Counter(t for i in tokens if bad[i] == b for t in tokens[i]) for b in (True, False)}
    size = len(set(counts[True]) | set(counts[False])) + 1
    prior = math.log(sum(bad.values()) + 1) - math.log(len(bad) - sum(bad.values()) + 1)
    p = lambda b, t: math.log((counts[b][t] + 1) / (sum(counts[b].values()) + size))
    out = {}
    for i, (host, path) in parsed.items():
        fits = [(len(r), r, v) for v, r in RULES for h, _, rest in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + rest)]
        score = prior + sum(p(True, t) - p(False, t) for t in tokens[i])
        out[i] = host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if score > 0 else "allow", score
    return out, words


def test_against_brute_force(spark):
    rows = list(enumerate(URLS))
    want, words = brute(rows)
    got = {r.page_id: r for r in urls.judge(frame(spark, rows), RULES).collect()}
    assert got.keys() == want.keys()
    for i, (host, path, rule, verdict, score) in want.items():
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), URLS[i]
        assert r.score == pytest.approx(score)
    assert words["greenhouse.com"][:2] == ["green", "house"] and got[7].verdict == "block" and got[6].verdict == "allow"
    assert got[0].rule == "example.net/en/" and got[1].rule == "net/" and got[13].host == "" and got[17].path == "//b.net/p"


def test_viterbi():
    assert urls.split_name("redcar", {(0, 3): 5, (3, 3): 5, (0, 1): 50}, 100) == ["red", "car"]
    assert urls.split_name("", {}, 0) == [] and urls.split_name("zzz", {}, 0) == ["zzz"]
    long = "a" * 60
    assert "".join(urls.split_name(long, {}, 9)) == long


def test_repeated_rows_null_ids_and_no_rows(spark):
    got = urls.judge(frame(spark, [(None, "http://a.com/"), (1, None), (1, None)]), RULES).collect()
    assert sorted((str(r.page_id), r.host, r.verdict) for r in got) == [("1", "", "allow"), ("1", "", "allow"), ("None", "a.com", "allow")]
    assert urls.judge(frame(spark, []), RULES).count() == 0
