from __future__ import annotations

import hashlib
import random
import re

from stratagraph.llm import pii

from .data import frame, prose, texts

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base_spans(t):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t) if good(kind, m[0])]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def awkward():
    rng = random.Random(7)
    parts = ["a@b.co", "x@y", "a@b.c_d@e.f", "%+-._@z-9.q.w.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "1 2-3 4", "+1 (415) 555-2671", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++44 20 7946 0958.", "😀é", "\n", "at", "user [at] host [dot] org", "415-555-2671", "..@..", "@", "5.5.5.5@x.y", "99999999999999999999.1.1.1"]
    return [("".join(rng.choice(parts) + rng.choice(["", " ", ", ", "-", "."]) for _ in range(rng.randint(1, 12)))) for _ in range(250)]


def test_base_spans_like_brute_force(spark):
    rows = [r for r in texts() if r[0] != 132] + [(1000 + k, t, "a") for k, t in enumerate(awkward())]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        want, r = base_spans(t or ""), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        mine = r.spans.split(",") if r.spans else []
        assert set(want) <= set(mine) and mine == sorted(mine, key=lambda x: (int(x.split(":")[1]), list(BASE).index(x.split(":")[0])))


def test_method_adds_written_out_addresses(spark):
    rng = random.Random(8)
    rows = [(k, f"{prose(rng, 5)} mail ann{k}@host{k}.org or call +1 415 555 {2000 + k} {prose(rng, 5)}", "a") for k in range(60)]
    rows += [(100 + k, f"{prose(rng, 5)} write to mail bob{k} [at] host{k} [dot] com today", "a") for k in range(20)]
    got = pii.find_personal_data(frame(spark, rows)).collect()
    assert all(r.n_email == 1 and r.n_phone == 1 for r in got if r.doc_id < 60)
    assert all(r.spans.count("email:") == 1 and r.n_email == 0 for r in got if r.doc_id >= 100)


def test_long_runs_are_linear(spark):
    rows = [(1, "a" * 400_000 + "@", "a"), (2, "9" * 400_000, "a"), (3, "1." * 200_000, "a"), (4, "+1 " * 100_000, "a"), (5, "a@b." * 100_000, "a"), (6, "1 " * 200_000, "a")]
    got = pii.find_personal_data(frame(spark, rows)).collect()
    assert len(got) == 6


def test_em_finds_reliable_labelers():
    """Three labelers that know something, which identify the rates, and one that votes at random."""
    rng, rates = random.Random(9), [(0.95, 0.05), (0.8, 0.3), (0.9, 0.15), (0.5, 0.5)]
    counted: dict = {}
    for _ in range(20_000):
        true = rng.random() < 0.6
        v = tuple(int(rng.random() < (t if true else f)) if rng.random() < 0.8 else -1 for t, f in rates)
        counted[v] = counted.get(v, 0) + 1
    prior, rate, post = pii.reliabilities(sorted(counted.items()))
    assert abs(prior - 0.6) < 0.05
    for got, want in zip(rate, rates, strict=True):
        assert abs(got[0] - want[0]) < 0.06 and abs(got[1] - want[1]) < 0.06
    sure = [(p, v) for (v, _), p in zip(sorted(counted.items()), post, strict=True) if v[:3] in ((1, 1, 1), (0, 0, 0))]
    assert all((p > 0.9) == (v[0] == 1) and (p < 0.1) == (v[0] == 0) for p, v in sure)


def test_added_spans_overlap_no_base_span(spark):
    rows = [(k, t, "a") for k, t in enumerate(awkward())]
    for r in pii.find_personal_data(frame(spark, rows), threshold=0.0).collect():
        base = {tuple(x.split(":")) for x in base_spans(dict((i, t) for i, t, _ in rows)[r.doc_id])}
        for x in (tuple(x.split(":")) for x in r.spans.split(",") if x):
            assert x in base or all(int(x[2]) <= int(b[1]) or int(b[2]) <= int(x[1]) for b in base), r


def test_very_many_spans(spark):
    text = " ".join(f"write ann{k}@host.org or bob{k} [at] host{k} [dot] com or 415-555-{1000 + k % 9000}" for k in range(20_000))
    r = pii.find_personal_data(frame(spark, [(1, text, "a")])).first()
    assert r.n_email == 20_000 and r.spans.count(",") >= 20_000


def test_native_repeats_and_empty(spark):
    df = pii.find_personal_data(frame(spark))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert len(df.collect()) == len(texts())
    assert pii.find_personal_data(frame(spark).limit(0)).count() == 0
