import hashlib
import re

from tesserae.llm import pii
from tests.llm import util

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


TRICKY = [
    "a@b.c@d.e x.y@z", "a@b.c_x@d.e", "..@..", "é a.b+c@mail-1.example.co.uk, ü", "1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.1 1..2.3.4.5",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+1 (319) 555-5132. +1234 +12345678901234567 ++44 20 7946 0958-", "5500005555555559" * 3,
    "@@@@ +++ 12 1.2.3", "9" * 5000, "a" * 5000 + "@", "1 " * 3000, "mail me:\tjoe@x.org\njoe@x.org", "𝔘nicode 𝔘 1.1.1.1",
]


def test_op7_base_against_plain_patterns(spark, tmp_path):
    texts = util.odd_texts() + TRICKY
    sf = util.write(spark, tmp_path, documents=util.clash(util.docs(spark, texts)))
    for r in pii.op7_pii(spark, sf).collect():
        expected = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(e.startswith(k) for e in expected) for k in PLAIN]
        assert [s for s in r.spans.split(",") if s and not s.startswith("id:")] == expected


HEX = ["be8a8e7152a5c568b61c22d1a2f7a0e3", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", "11acdfb36bb72224148e6160f674b4be45601bff"]


def found(spark, texts):
    return {r.id: [(s.s, s.e) for s in r.id_spans] for r in pii.find_pii(util.docs(spark, texts)).collect()}


def test_patterns_are_induced_from_seeds(spark):
    """No word is known beforehand: emails and keys by form lead to their contexts, and these to identifiers of other forms."""
    seeds = [f"my contact is u{k}@mail.example.com today" for k in range(6)]
    fresh = ["my contact is AB12-9981-XZ today", "nothing 2024 here", "the build 123abc456 ran"]
    named = [f'a zugang = "{h}" ok' for h in HEX] + ['its zugang = "hunter" ok', 'and zugang = "a_b.c+d=="', "zugang of the 77x7y", 'kein wort = "hunter2"']
    texts = seeds + fresh + named + ["elsewhere AB12-9981-XZ again"]
    got = found(spark, texts)
    where = lambda k, v: [(texts[k].index(v), texts[k].index(v) + len(v))]
    assert got[6] == where(6, "AB12-9981-XZ") and got[7] == [] and got[8] == []
    for k, h in enumerate(HEX):
        assert got[9 + k] == where(9 + k, h)
    assert got[13] == where(13, "hunter") and got[14] == where(14, "a_b.c+d==") and got[15] == [] and got[16] == []
    assert got[17] == where(17, "AB12-9981-XZ")  # known by its value


def test_common_words_before_seeds_are_not_trusted(spark):
    texts = [f"it was the {h} that came" for h in HEX] + ["the code the name the rest"] * 5 + ["say the 12ab34 now"]
    got = found(spark, texts)
    assert [len(got[k]) for k in range(4)] == [1] * 4 and got[9] == []


def graph_brute(edges, places, support, confidence):
    from math import exp, log

    graph, times = {}, {}
    for p, v, seed in edges:
        graph.setdefault(p, {})[v] = graph.get(p, {}).get(v, False) or seed
        times[p] = times.get(p, 0) + 1
    n = {p: len(vs) + max(0, places.get(p, 0) - times[p]) for p, vs in graph.items()}
    seeds = {v for vs in graph.values() for v, s in vs.items() if s}
    known, good = {v: 1.0 for v in seeds}, {}
    while True:
        fresh = {}
        for p, vs in graph.items():
            mass = sum(known.get(v, 0) for v in vs)
            if p not in good and n[p] >= support and mass >= support - 1e-9 and mass / n[p] >= confidence:
                fresh[p] = min(mass / n[p], 0.999)
        if not fresh:
            return good, known
        good |= fresh
        known = {v: 1.0 for v in seeds}
        for v in {v for p in good for v in graph[p]} - seeds:
            known[v] = 1 - exp(sum(log(1 - good[p]) for p in good if v in graph[p]))


def test_graph_scores_against_brute_force(spark):
    import random

    r = random.Random(5)
    edges = [("1p0", f"v{i}", True) for i in range(4)] + [("1p0", "v0", True), ("1p0", "v9", False)]
    for c in range(1, 9):
        edges += [(f"1p{c}", f"v{4 * k + i}", k == 0) for k in (c - 1, c) for i in range(4)]
    edges += [(f"2q{k}", f"v{r.randrange(6 + 3 * k)}", False) for k in range(12) for _ in range(14)]
    edges = [(p, v, s or int(v[1:]) < 12) for p, v, s in edges]
    places = {"1p3": 12, "1p5": 200}
    good, known = pii.trusted(spark.createDataFrame(edges, "pattern string, v string, seed boolean"), spark.createDataFrame(list(places.items()), "pattern string, places long"))
    best, sure = graph_brute(edges, places, pii.SUPPORT, pii.CONFIDENCE)
    got = {x.pattern: x.conf for x in good.collect()}
    assert got.keys() == best.keys() and len(best) > 4 and all(abs(got[p] - best[p]) < 1e-6 for p in best)
    got = {x.v: x.conf for x in known.collect()}
    assert got.keys() == sure.keys() and all(abs(got[v] - sure[v]) < 1e-6 for v in sure)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{k}@h.org x = id{k}" for k in range(4000))
    (row,) = pii.find_pii(util.docs(spark, [text])).collect()
    assert len(row.email) == 4000 and [(e.s, e.e) for e in row.email] == [(m.start(), m.end()) for m in re.finditer(PLAIN["email"], text)]


def test_pii_of_nothing_and_repeats(spark):
    assert pii.find_pii(util.docs(spark, [])).count() == 0
    df = util.docs(spark, ["password=7602ad27cf5550de1c7602ad27cf5550de"] * 3, ids=[1, 1, None])
    assert [len(r.id_spans) for r in pii.find_pii(df).collect()] == [1, 1, 1]
