import random
import re

from tessera.llm import quotation as Q


def parsed_alone(text):
    """An own parser: [(level, lines)] and the clean text, by peeling marks character by character."""
    lines = []
    for line in (text or "").split("\n"):
        level, i, j = 0, 0, 0
        while j < len(line) and j < 3 and line[j] in " \t":
            j += 1
        while j < len(line) and line[j] == ">":
            level, j = level + 1, j + 1
            if j < len(line) and line[j] in " \t":
                j += 1
            i = j
        lines.append((level, line[i:]))

    def introduces(n):
        level, line = lines[n]
        if level or not re.search(r"(^On\b.*\bwrote|\b(wrote|writes|schrieb|escribió|a écrit))\s*:\s*$", line):
            return False
        after = [lv for lv, body in lines[n + 1 :] if lv > 0 or body.strip()]
        return bool(after) and after[0] > 0

    keep = [not introduces(n) for n in range(len(lines))]
    blocks, last = [], None
    for (level, line), here in zip(lines, keep):
        at = level if here and line.strip() else None
        if at is not None:
            if at != last:
                blocks.append((level, []))
            blocks[-1][1].append(line.strip())
        last = at
    return blocks, "\n".join(line.rstrip() for (lv, line), here in zip(lines, keep) if lv == 0 and here).strip()


def flat(text):
    return " ".join(text.lower().split())


def pieces(lines):
    whole, found, at = flat(" ".join(lines)), [], 0
    for m in re.finditer(r"[.!?…][\"')\]]*\s+", whole):
        end = m.start() + 1
        found.append(whole[at:end])
        at = m.end()
    return {u for u in [whole, *found, whole[at:], *map(flat, lines)] if len(u.split()) >= 3}


def brute(rows):
    """rows (group, position, role, text); the same rules over plain lists, with a parser of its own."""
    nodes = {}
    for g, p, _, t in rows:
        if g is not None and p is not None:
            nodes.setdefault((g, p), set()).update((lv, tuple(ls)) for lv, ls in parsed_alone(t)[0])
    first, first_unit = {}, {}
    for (g, p), found in nodes.items():
        for lv, ls in found:
            if lv == 0:
                x = flat(" ".join(ls))
                first[g, x] = min(p, first.get((g, x), p))
                for u in pieces(ls):
                    first_unit[g, u] = min(p, first_unit.get((g, u), p))
    parent, counted = {}, {}
    for (g, p), found in nodes.items():
        quoted = {}
        for lv, ls in found:
            if lv:
                quoted.setdefault((lv, flat(" ".join(ls))), set()).update(pieces(ls))
        weight, linked = {}, 0
        for (lv, x), units in quoted.items():
            if first.get((g, x), p) < p:
                votes = [(first[g, x], x)]
            else:
                votes = [(first_unit[g, u], u) for u in units if first_unit.get((g, u), p) < p]
            linked += bool(votes)
            for o, u in votes:
                weight[lv, o] = weight.get((lv, o), 0) + len(u.encode())
        best = min(((lv, -w, -o) for (lv, o), w in weight.items()), default=None)
        parent[g, p] = None if best is None else -best[2]
        counted[g, p] = (len(quoted), linked)

    def up(g, p):
        return (p, 0) if parent[g, p] is None else (lambda r: (r[0], r[1] + 1))(up(g, parent[g, p]))

    threads = {}
    for g, p in sorted(nodes):
        threads.setdefault((g, up(g, p)[0]), []).append(p)
    out = []
    for g, p, role, t in rows:
        clean = parsed_alone(t)[1]
        if (g, p) in nodes:
            root, depth = up(g, p)
            out.append((g, p, role, parent[g, p], root, depth, threads[g, root].index(p), *counted[g, p], clean))
        else:
            out.append((g, p, role, None, None, None, None, 0, 0, clean))
    return sorted(out, key=str)


def test_passages():
    text = "Hi Ann,\n\nOn Monday Bob wrote:\n> > first\n> > wrapped\n> \n> second one\n>> third\n\nI agree\nfully.\n> late"
    got, clean = Q.passages_of(text)
    assert got == [(0, "Hi Ann,"), (2, "first wrapped"), (1, "second one"), (2, "third"), (0, "I agree fully."), (1, "late")]
    assert clean == "Hi Ann,\n\n\nI agree\nfully."
    assert Q.passages_of(None) == ([], "") and Q.passages_of("") == ([], "")
    assert Q.passages_of("She wrote:\nno quote follows")[1] == "She wrote:\nno quote follows"


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows, said = [], {}
    for g in range(6):
        for p in range(0, 40):
            own = rng.choice(["ok", f"note {g} {p}", f"long text of {p}\nsecond line", "Ünï " * rng.randint(1, 4)])
            quotes = ""
            if p and rng.random() < 0.8:
                q = rng.randrange(max(0, p - 5), p)
                quotes = "On day they wrote:\n" + "".join(f"> {line}\n" for line in said[g, q].upper().split("\n")) + "> > never said\n\n"
            said[g, p] = own
            rows.append((g, p * 300, "user", quotes + own))
    rows += [rows[3], (None, 4, "user", "> ok\n\nalone"), (2, None, "user", "x"), (9, 1, None, None), (9, 2, "a", ""), (9, 3, "a", "> " * 400 + "deep\n" + "w " * 50000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int")
    assert sorted((tuple(r) for r in Q.conversations(df).collect()), key=str) == brute(rows)
    assert Q.conversations(df.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(1, p, "u", (f"> word{p - 1}\n\n" if p else "") + f"word{p}") for p in range(70)]
    got = {r.turn: (r.parent, r.root, r.depth, r.reply_index) for r in Q.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {p: (p - 1 if p else None, 0, p, p) for p in range(70)}


def test_given_turns(spark, sf):
    mail = Q.as_mail(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in mail]
    want = brute(rows)
    got = Q.linked_conversations(spark, sf).drop("clean_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((r[:9] for r in want), key=str)
    # most turns answer the turn they were made to quote
    back = {(g, p): p - (2 if (g * 7 + p * 3) % 4 == 0 else 1) for g, p, _, _ in rows}
    told = [(r[3], back[r[0], r[1]]) for r in want if back[r[0], r[1]] >= 0]
    assert sum(a == b for a, b in told) > 0.95 * len(told)


def test_trimmed_quotes_link(spark):
    """A reply that quotes one sentence, or some lines, of a longer paragraph answers its writer."""
    long = "We met on Monday at noon. The bridge is closed until May! Who will tell the mayor?"
    lines = "first point of the list\nsecond point is longer\nthird point ends it"
    rows = [
        (1, 1, "a", long), (1, 2, "b", lines), (1, 3, "c", "> The bridge is closed\n> until May!\n\nToo bad."),
        (1, 4, "d", "> second point is longer\n> third point ends it\n\nAgreed."), (1, 5, "e", "> until May!\n\nToo short to tell."),
        (1, 6, "f", "> We met on Monday at noon. [...] Who will tell the mayor?\n\nI will."), (1, 7, "g", "> nobody said this at all\n\nx"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: (r.parent, r.quoted, r.linked) for r in Q.conversations(df).collect()}
    assert got[3] == (1, 1, 1) and got[4] == (2, 1, 1) and got[5] == (None, 1, 0) and got[6] == (1, 1, 1) and got[7] == (None, 1, 0)
    assert sorted((tuple(r) for r in Q.conversations(df).collect()), key=str) == brute(rows)


def test_equals_brute_force_on_trimmed_quotes(spark):
    rng = random.Random(12)
    words = ["red", "blue", "ox", "tree", "runs", "far", "ago", "why"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) + rng.choice([".", "!", "?", "?)", ""])
    rows, said = [], []
    for p in range(120):
        own = "\n".join(" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
        lead = ""
        if said and rng.random() < 0.8:
            cut = rng.choice(said[-6:]).split("\n")
            cut = rng.sample(cut, rng.randint(1, len(cut)))
            lead = "".join(f"> {line if rng.random() < 0.6 else line[: rng.randint(3, 40)]}\n" for line in cut) + "\n"
        said.append(own)
        rows.append((p % 2, p, "u", lead + own))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted((tuple(r) for r in Q.conversations(df).collect()), key=str)
    assert got == brute(rows) and sum(r[8] > 0 for r in got) > 40
