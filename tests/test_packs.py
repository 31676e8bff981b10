"""Evidence packs against plain loops."""

import random
import re

from loomgraph.plans import packs as P


def words(text):
    return [w for w in re.sub("[^a-z0-9]+", " ", (text or "").lower()).split() if len(w) > 3]


def score(target, page):
    known = set(words(target))
    return sum(any(w.startswith(k) or k.startswith(w) for k in known) for w in words(page))


def expanded(text):
    return " ".join([text, *(w for k, v in P.CONCEPTS.items() if k in text.lower() for w in v)])


def test_packs(spark):
    rng = random.Random(6)
    some = ["card", "cards", "carding", "browse", "payment", "pay", "orders", "order", "schema", "migrations", "photo", "the", "gridded"]
    say = lambda n: " ".join(rng.choice(some) for _ in range(n))
    kinds = ["project", "pull_request", "decision", "customer_feedback", "process"]
    nodes = [(i, rng.choice(kinds), say(2), rng.choice([None, "", say(3)]), rng.random() < 0.3, rng.random() < 0.3, rng.randrange(4)) for i in range(40)]
    pages = [(i, say(4) if i % 7 else None) for i in range(40) if i % 5]
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice(["APPLIES_TO", "RELATED_TO"]), rng.choice([0.2, 0.5, 0.9])) for _ in range(60)]
    targets = [(n[0], n[2], n[4]) for n in nodes if n[1] == "project"]
    page, node = dict(pages), {n[0]: n for n in nodes}
    want, heard = {}, {}
    for t, text, _ in targets:
        near = {}
        for a, b, _, w in edges:
            for x, y in ((a, b), (b, a)):
                if x == t:
                    near[y] = max(near.get(y, 0), w)
        found = []
        for i, kind, _, _, proposed, rule, _ in nodes:
            if i == t or i not in page or proposed or kind not in P.BONUS:
                continue
            n = score(expanded(text), page[i])
            if i in near and not rule:
                found.append((-round(n * 2 + near[i] * 3 + P.BONUS[kind], 6), i))
            elif kind != "decision" and n >= 2:
                found.append((-round(n * 2.0 + P.BONUS[kind], 6), i))
        want[t] = [(i, -s) for s, i in sorted(found)[: P.PRECEDENTS]]
        talk = [i for i, kind, _, said, *_ in nodes if kind == "customer_feedback" and said]
        direct = [i for i in talk if i in near]
        heard[t] = [(i, i in near) for i in (direct + [i for i in talk if i not in near and score(text, f"{node[i][2]} {node[i][3]}")])[: P.FEEDBACK]]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    n = df(nodes, "node long, type string, name string, said string, proposed boolean, convention boolean, refs int")
    e, p, t = df(edges, "src long, dst long, type string, weight double"), df(pages, "page long, text string"), df(targets, "node long, text string, proposed boolean")
    got = {}
    for r in P.precedents(t.select("node", "text"), n, e, p).orderBy("node", "place").collect():
        got.setdefault(r.node, []).append((r.precedent, r.score))
    assert got == {k: v for k, v in want.items() if v}
    got = {}
    for r in P.feedback(t.select("node", "text"), n, e).orderBy("node", "place").collect():
        got.setdefault(r.node, []).append((r.item, r.direct))
    assert got == {k: v for k, v in heard.items() if v}
    rows = {r.node: r for r in P.packs(t, n, e, p).collect()}
    assert set(rows) == set(want)
    for k, r in rows.items():
        assert r.precedents == "|".join(str(i) for i, _ in want[k]) and r.feedback == "|".join(str(i) for i, _ in heard[k])
        assert ("precedents" in r.gaps.split("|")) == (not want[k]) and ("contracts" in r.gaps.split("|")) == node[k][4]
        stored = any(re.search(r"\b(database|schema|migration|model)\b", page[i] or "") for i, _ in want[k])
        assert ("database" in r.gaps.split("|")) == (node[k][4] and not stored)
        assert r.precedent_refs == sum(node[i][6] for i, _ in want[k]) and r["items"] == r.rule_refs + r.precedent_refs + len(heard[k])
    assert P.packs(t.limit(0), n, e, p).count() == 0 and P.packs(t, n.limit(0), e.limit(0), p.limit(0)).count() == len(targets)
