import datetime as D
import random
import re

from tessera.llm import url_filter as U


def brute_keys(url):
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)[^/?#]*(/[^?#]*)?", url or "")
    if not m:
        return []
    host = m.group(1).lower().rstrip(".")
    labels, seg = host.split("."), [s for s in (m.group(2) or "").split("/") if s]
    return ["d:" + ".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] + ["p:" + host + "/" + "/".join(seg[: i + 1]) for i in range(len(seg))]


def brute(captures, entries):
    state = {}
    for lst, action, kind, value, day, on in entries:
        if None in (lst, action, value, day, on):
            continue
        key = ("d:" + value.lower()) if kind == "domain" else "p:" + value
        days = state.setdefault((lst, action, key), {})
        days[day] = min(days.get(day, True), on)
    out = []
    for i, url, day in captures:
        active = []
        for (lst, action, key), days in state.items():
            before = [d for d in days if day is not None and d <= day]
            if before and days[max(before)] and key in brute_keys(url):
                active.append((-len(key), not key.startswith("p:"), action != "allow", lst, key, action))
        best = min(active) if active else None
        out.append((i, url, day, len(active), best[5] if best else "none", best and best[4], best and best[3]))
    return sorted(out, key=str)


def day(n):
    return D.date(2024, 1, 1) + D.timedelta(days=n)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    hosts = ["a.example.com", "example.com", "B.example.com", "x.y.example.org", "localhost", "deep.a.example.com"]
    captures = [(n, f"http://{rng.choice(hosts)}{rng.choice(['', ':80', '.'])}/{rng.choice(['en', 'de', 'En'])}/{rng.choice(['a', 'b'])}?q#f", day(rng.randint(0, 200))) for n in range(200)]
    captures += [(900, None, day(3)), (901, "no url", day(3)), (902, "http://example.com", None), (None, "https://u:p@example.com/en", day(50)), (5, captures[5][1], captures[5][2])]
    entries = [(f"l{rng.randint(0, 2)}", rng.choice(["block", "allow"]), "domain", rng.choice(hosts[:5]), day(rng.randint(0, 200)), rng.random() < 0.6) for _ in range(40)]
    entries += [("p", "block", "prefix", rng.choice(["a.example.com/en", "example.com/de/a", "localhost/en"]), day(rng.randint(0, 200)), rng.random() < 0.7) for _ in range(12)]
    entries += [(None, "block", "domain", "example.com", day(1), True), ("l", "block", "domain", None, day(1), True), ("l", "block", "domain", "example.com", None, True)]
    c = spark.createDataFrame([(*r, "k") for r in captures], "page_id bigint, url string, fetched_on date, key string")
    e = spark.createDataFrame([(*r, 1) for r in entries], "list string, action string, kind string, value string, day date, listed boolean, month int")
    assert sorted((tuple(r) for r in U.filter_captures(c, e).collect()), key=str) == brute(captures, entries)
    assert {r.verdict for r in U.filter_captures(c, e.limit(0)).collect()} == {"none"}
    assert U.filter_captures(c.limit(0), e).count() == 0


def test_intervals(spark):
    rows = [("l", "block", "domain", "x.com", day(1), True), ("l", "block", "domain", "x.com", day(9), False), ("l", "block", "domain", "x.com", day(20), True), ("l", "block", "domain", "x.com", day(20), False), ("l", "block", "domain", "x.com", day(30), True)]
    df = spark.createDataFrame(rows, "list string, action string, kind string, value string, day date, listed boolean")
    got = sorted((tuple(r)[3:] for r in U.validity(df).collect()), key=str)
    assert got == [(day(1), day(9)), (day(30), None)]
