import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scribemend.llm import pii

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(digits[::-1]):
            d = int(c) * (2 if i % 2 else 1)
            total += d // 10 + d % 10
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES) for m in re.finditer(rule, text) if valid(kind, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a.@-+ 012459()%é²\n_Z"), max_size=60))
def test_like_the_plain_rules(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", [
    "a@b.c@d.e", "x@y@z.com", "a@b", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "1234567890.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "0" * 16, "+1 (555) 123-4567", "+1 555", "+1 (555) 123-4567 +44 20 7946 0958",
    "9" * 6000, "a" * 50000 + "@", ("a" * 50 + "@") * 500, "1." * 20000, "+1 " * 5000, "5105105105105100 " * 40])
def test_known_cases_and_long_runs(text):
    assert pii.base_spans(text) == plain(text)


def test_rows(documents):
    rows = [(1, "mail é a.b@c.de now +1 (555) 123-4567"), (2, None), (3, ""), (None, "8.8.8.8"), (1, "mail é a.b@c.de now +1 (555) 123-4567"), (2**60 + 1, "x")]
    got = sorted((tuple(r)[:7] for r in pii.personal_data(documents(rows)).collect()), key=str)
    want = []
    for name, text in rows:
        spans = plain(text or "")
        said = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans)
        want.append((name, *(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(said.encode()).hexdigest(), said))
    assert got == sorted(want, key=str)
    assert pii.personal_data(documents([])).count() == 0


def test_contexts_discover_unseen_identifiers(documents):
    r = random.Random(2)
    seeds = [(i, f"some text {r.random()} call me at +1 (555) {r.randrange(100, 999)}-{r.randrange(1000, 9999)} please") for i in range(40)]
    unseen = [(100 + i, f"please call me at 555{i}-12345{i} today") for i in range(3)]
    clean = [(200 + i, f"the year was {1900 + i} and part no. 12345{i} is here") for i in range(30)]
    rows = {r["doc_id"]: r for r in pii.personal_data(documents(seeds + unseen + clean)).collect()}
    for i, text in unseen:
        value = text.split()[4]
        start = text.index(value)
        assert rows[i]["spans"] == f"phone:{start}:{start + len(value)}" and rows[i]["n_found"] == 1 and rows[i]["n_phone"] == 0
        assert rows[i]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(rows[i]["spans"] == "" for i, _ in clean)
    assert all(rows[i]["n_found"] == 0 and rows[i]["n_phone"] == 1 for i, _ in seeds)


def brute_force(rows):
    """Scores of patterns by plain loops over (value, kind, never, patterns) of every mention."""
    edges = {}
    for value, kind, never, patterns in rows:
        for p in patterns:
            old = edges.get((p, value), (None, None, 0))
            edges[p, value] = (max((x for x in (kind, old[0]) if x is not None), default=None),
                               max((x for x in (never, old[1]) if x is not None), default=None), old[2] + 1)
    own = {}
    for p in {p for p, _ in edges}:
        seeds = {}
        for (q, _), (kind, _, n) in edges.items():
            if q == p and kind is not None:
                seeds.setdefault(kind, []).append(n)
        ranked = sorted((-len(ns), kind) for kind, ns in seeds.items() if len(ns) >= pii.SUPPORT)
        if ranked:
            own[p] = ranked[0][1]
    belief = {(p, v): float(kind == own[p]) for (p, v), (kind, _, _) in edges.items() if p in own}
    for step in range(pii.ROUNDS + 1):
        score = {p: sum(edges[e][2] * b for e, b in belief.items() if e[0] == p) / sum(edges[e][2] for e in belief if e[0] == p) for p in own}
        if step < pii.ROUNDS:
            for p, v in belief:
                kind, never, _ = edges[p, v]
                if kind is None and never != own[p]:
                    belief[p, v] = max((score[q] for q, w in belief if w == v and own[q] == own[p] and q[0] in pii.VIEWS[p[0]]), default=0.0)
    return {(p, own[p], sum(edges[e][2] for e in belief if e[0] == p),
             sum(edges[e][2] for e in belief if e[0] == p and edges[e][0] == own[p]), round(score[p], 9)) for p in own}


def test_scores_like_plain_loops(documents):
    r = random.Random(4)
    texts = []
    for i in range(250):
        number = r.choice([f"+1 (555) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}", f"555-{r.randrange(10000, 99999)}", f"{r.randrange(10**15, 10**16)}",
                           f"{r.randrange(300)}.1.{r.randrange(300)}.9", "x@y.com", f'token = "{r.randrange(16**32):032x}"', f"+1 (555) 123-{r.randrange(1000, 9999)} 8.8.8.8"])
        texts.append((i, f"{r.choice(['so', 'and'])} {r.choice(['call', 'pay', 'see'])} {number} {r.choice(['now', 'today', 'please'])} ok"))
    texts += texts[:30] + [(999, None), (998, "")]
    found = pii.scan(documents(texts))
    got = {(p["pattern"], p["kind"], p["n"], p["seeds"], round(p["score"], 9)) for p in pii.scored_patterns(found).collect()}
    want = brute_force([(m[5], m[2], m[4], m[6]) for _, text in texts for m in pii.mentions(text or "")])
    assert got == want and any(0 < row[4] < 1 for row in got)


def test_one_word_before_and_after_varying_words(documents):
    names = ["Ann", "Bob", "Eve", "Joe", "Kim", "Lea", "Max"]
    seeds = [(i, f"{name} phone: +4{i} 171 555 01{i}0 {name}") for i, name in enumerate(names)]
    clean = [(50 + i, f"the year {1900 + i} and the 2000{i} others") for i in range(9)]
    rows = {r["doc_id"]: r for r in pii.personal_data(documents([*seeds, (20, "Zoe phone: 0171-5550101 Zoe"), *clean])).collect()}
    assert rows[20]["spans"] == "phone:11:23" and rows[20]["n_found"] == 1
    assert all(rows[i]["spans"] == "" for i, _ in clean)


def test_frequent_words_are_no_patterns(documents):
    seeds = [(i, f"go to the {i + 1}.2.3.4 then") for i in range(5)]
    other = [(50 + i, "the cat and the dog in the house by the sea") for i in range(20)]
    rows = {r["doc_id"]: r for r in pii.personal_data(documents([*seeds, *other, (99, "in the 12345 ways")])).collect()}
    assert rows[99]["spans"] == ""


def test_shapes_find_what_a_rule_dropped_but_not_what_it_refused(documents):
    seeds = [(i, f"a{i} +1 (555) 555-1{i}0 b{i}") for i in range(10, 40)] + [(100 + i, f"c{i} 1{i}.20.30.40 d{i}") for i in range(10, 40)]
    rows = {r["doc_id"]: r for r in pii.personal_data(documents([*seeds, (1, "xx +1 (555) 555-9999 120.20.30.40 yy"), (2, "zz 999.20.30.40 ww")])).collect()}
    assert rows[1]["spans"] == "phone:3:20,ip:21:33" and rows[1]["n_phone"] == 0 and rows[1]["n_found"] == 1
    assert rows[2]["spans"] == ""


def test_credentials_are_seeds(documents):
    text = 'API_KEY: "abcdef0123456789" and password=short1 token = word-without-number'
    assert [(m[0], m[1], m[2]) for m in pii.mentions(text) if m[2] == pii.SECRET] == [(10, 26, pii.SECRET)]
    row = pii.personal_data(documents([(1, text)])).first()
    assert row["spans"] == "secret:10:26" and row["n_secret"] == 1 and row["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_words_and_values_of_any_length():
    word, value = "w" * 3000, "9" * 5000 + "@"
    pattern = pii.patterns(f"{word}a {word}b {value} {word}c", 6004, 6004 + len(value))
    assert pattern == pii.patterns(f"x {word}a {word}b {value} {word}c", 6006, 6006 + len(value))
    assert len(set(pattern)) == 5 and all(len(p) < 200 for p in pattern)
