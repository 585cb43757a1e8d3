"""Personal data and disclosing terms against plain loops over a planted corpus."""

import hashlib
import math
import random
import re
from collections import Counter

from chronoflux.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def planted():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(60)]
    out = []
    for i in range(120):
        w = [r.choice(words) for _ in range(r.randrange(5, 60))]
        if i % 8 == 0:
            w[2:2] = ["Zanzibar,", "write", "ann@isle.example"]  # a value that recurs, and a term that comes with it only
        if i % 10 == 3:
            w += [f"u{i}@corp.example", "Quarterly"] + ["zanzibar"] * (i == 3)
        if i % 15 == 5:
            w.insert(0, r.choice(["10.0.0.7", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (736) 555-2678", "+12", "a@b.c_d@e.f"]))
        out.append((i, " ".join(w)))
    return out + [(200, None), (201, ""), (202, "İZMİR ann@isle.example ZANZIBAR éàùann@isle.exampleétude"), (203, out[8][1]), (204, out[3][1]), (205, out[3][1])]


def brute(rows, support=3, generalise=0.6, remove=0.8):
    def blank(t):
        return re.sub(BASE["email"], lambda m: " " * len(m[0]), t)

    def terms(t):
        return {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", blank(t))}

    docs = [(i, t or "") for i, t in rows]
    base, ents = [], []
    for _, t in docs:
        found, e = [], set()
        for n, (kind, p) in enumerate(BASE.items()):
            for m in re.finditer(p, t):
                if good(kind, m[0]):
                    v = m[0].lower()
                    found.append((n, m.start(), m.end()))
                    e |= {kind, f"{kind}:{v if n < 2 else re.sub('[^0-9]', '', v)}"} | ({"@" + v.split("@")[-1]} if n == 0 else {".".join(v.split(".")[:3]) + ".*"} if n == 1 else set())
        base.append(found)
        ents.append(e)
    n = len(docs)
    rows_e, texts_e = Counter(e for es in ents for e in es), Counter(e for _, es in {(t, frozenset(es)) for (_, t), es in zip(docs, ents, strict=True)} for e in es)
    rows_t, joint, texts = Counter(), Counter(), {}
    for (_, t), es in zip(docs, ents, strict=True):
        rows_t.update(terms(t))
        for e in es:
            for x in terms(t):
                joint[e, x] += 1
                texts.setdefault((e, x), set()).add(t)
    score = {}
    for (e, x), j in joint.items():
        if texts_e[e] >= support and rows_e[e] < n and len(texts[e, x]) >= support:
            d = math.log(n * j / (rows_e[e] * rows_t[x])) / math.log(n / rows_e[e])
            if d >= generalise:
                score[e, x] = d
    out, dropped = {}, {}
    for (i, t), found, es in zip(docs, base, ents, strict=True):
        top = {x: max(score[e, x] for e in es if (e, x) in score) for x in terms(t) if any((e, x) in score for e in es)}
        added = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", blank(t)) if m[0].lower() in top and len(m[0]) >= 3]
        own = ",".join(f"{list(BASE)[k]}:{s}:{e}" for k, s, e in sorted(found))
        out[i] = (Counter(k for k, _, _ in found), hashlib.sha256(own.encode()).hexdigest(), ",".join(x for x in (own, ",".join(f"{k}:{s}:{e}" for k, s, e in added)) if x))
        dropped[i] = {x for x, d in top.items() if d >= remove}, {x for x, d in top.items() if d < remove}
    return out, dropped


def test_report_is_that_of_plain_loops(spark):
    rows = planted()
    want, dropped = brute(rows)
    assert "zanzibar" in dropped[8][0] and sum("term" in x[2] for x in want.values()) > 20
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for x in got:
        n, sha, spans = want[x["doc_id"]]
        assert (x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) == tuple(n[k] for k in range(4))
        assert (x["base_sha256"], x["spans"]) == (sha, spans)


def test_disclosing_terms_go_and_others_stay(spark):
    rows = planted()
    _, dropped = brute(rows)
    got = {x["doc_id"]: x["text"] for x in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = re.compile(r"[^\W\d_]{3,}")
    for i, t in rows:
        drop, mask = dropped[i]
        left = {m[0].lower() for m in plain.finditer(got[i])} - {"term", "email", "phone", "card"}
        assert not left & (drop | mask)
        assert "@" not in got[i] or i % 15 == 5
        if not re.search(r"[@+0-9]", t or ""):
            assert got[i] == (t or "")
